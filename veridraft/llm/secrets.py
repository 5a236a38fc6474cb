"""Secrets: fixed patterns, and a battery of randomness tests for unnamed ones.

Candidates are the runs of 20 or more letters, digits and ``+/_-`` of a text. Each is read in
the encoding its characters suggest, and three statistics compare it with uniform symbols:
chi-squared over the alphabet, the number of runs below and above the alphabet's middle, and
the correlation of neighbouring symbols. A candidate that all three call random is a secret
if ordinary text of the same length in that encoding would hardly look like this: that
p-value knows the length, as short strings of ordinary text pass any test. A candidate that
fails one of the three tests has a p-value of 1; one p-value per candidate goes through
Benjamini-Hochberg over all candidates of the corpus, so the level holds for what is put out.

Everything is built-in functions; the corpus-wide step is a histogram with a fixed number of
bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridraft.llm.common import table
from veridraft.llm.spans import listed, matches
from veridraft.session import materialise

KINDS = ["assign", "access", "hex", "random"]
_KEYS = ["password", "passwd", "secret", "token", "api_?key"]


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, _KEYS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A whole run of these characters matches or none of it, so the least length can be in the pattern.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Letters by how rare they are in prose (English, German, French, Spanish).
RARE = "jkqvwxyzbpfgmacdehilnorstu"
#: Groups of a UUID are read as one string of hexadecimal digits.
UUID = "^([0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9A-F]{8}(-[0-9A-F]{4}){3}-[0-9A-F]{12})$"
#: Fixed values by encoding: characters it may hold, its alphabet in order, and what ordinary
#: text in it looks like: chance that two symbols agree, chance that neighbours lie on
#: different sides of the alphabet's middle. The first encoding that fits is taken. Letters of
#: one case start with the rare ones: ordinary text hardly leaves the common half, random
#: strings do half the time; how often symbols agree can't tell short ones apart.
ENCODINGS = [
    ("[0-9]+", DIGITS, 0.14, 0.5),
    ("[0-9a-f]+", DIGITS + "abcdef", 0.15, 0.25),
    ("[0-9A-F]+", DIGITS + "ABCDEF", 0.15, 0.25),
    ("[a-z]+", RARE, 0.066, 0.35),
    ("[A-Z]+", RARE.upper(), 0.066, 0.35),
    ("[A-Z2-7]+", "234567" + RARE.upper(), 0.06, 0.25),
    ("[0-9a-z]+", DIGITS + RARE, 0.06, 0.25),
    ("[0-9A-Z]+", DIGITS + RARE.upper(), 0.06, 0.25),
    (".+", "+/" + DIGITS + LOWER.upper() + LOWER, 0.055, 0.15),
]
#: Every statistic of a random string lies within so many standard deviations.
LIMIT = 3.0
#: Share of false discoveries allowed among the strings called secrets.
FALSE_DISCOVERIES = 0.01
#: Bins of the ordinary-text statistic, a twentieth of a standard deviation each.
BINS_PER_UNIT, LAST_BIN = 20, 700


def statistics(value: Column, alphabet: str, agree: float, cross: float) -> Column:
    """(chi, runs, serial, ordinary): three standardised tests of uniform symbols, and how far
    the value lies from ordinary text of its length, in standard deviations."""
    k = len(alphabet)
    n = F.char_length(value).cast("double")
    squares = F.aggregate(
        F.transform(F.array(*(F.lit(c) for c in alphabet)), lambda c: n - F.char_length(F.replace(value, c, F.lit("")))),
        F.lit(0.0), lambda a, x: a + x * x,
    )
    excess = squares * k / n - n - (k - 1)
    chi = excess / math.sqrt(2 * (k - 1))
    sides = F.translate(value, alphabet, "0" * (k // 2) + "1" * (k // 2))
    crossings = n - F.char_length(F.replace(sides, F.lit("01"), F.lit("")))
    crossings = (crossings + n - F.char_length(F.replace(sides, F.lit("10"), F.lit("")))) / 2
    runs = (crossings - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
    middle, variance = (k - 1) / 2, (k * k - 1) / 12
    symbols = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c) - 1 - middle)
    products = F.zip_with(symbols, F.slice(symbols, 2, F.size(symbols)), lambda a, b: F.coalesce(a * b, F.lit(0.0)))
    serial = F.aggregate(products, F.lit(0.0), lambda a, x: a + x) / (variance * F.sqrt(n - 1))
    # Ordinary text: the same chi-squared, not central; and crossings as rare as its chance.
    shift = k * (1 + (n - 1) * agree) - n - (k - 1)
    even = (shift - excess) / F.sqrt(2 * (k - 1) + 4 * F.greatest(shift, F.lit(0.0)))
    busy = (crossings - (n - 1) * cross) / F.sqrt((n - 1) * cross * (1 - cross))
    ordinary = (even + busy) / math.sqrt(2) if cross < 0.5 else even
    return F.struct(chi.alias("chi"), runs.alias("runs"), serial.alias("serial"), ordinary.alias("ordinary"))


def judged(value: Column) -> Column:
    """Statistics of a candidate in the encoding its characters suggest."""
    plain = F.when(value.rlike(UUID), F.replace(value, F.lit("-"), F.lit(""))).otherwise(F.translate(value, "_-", "/+"))
    chosen = None
    for fits, alphabet, agree, cross in reversed(ENCODINGS):
        found = statistics(plain, alphabet, agree, cross)
        chosen = found if chosen is None else F.when(plain.rlike(f"^{fits}$"), found).otherwise(chosen)
    return chosen


def upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z), by a rational approximation with an error below 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z < 0, 1 - tail).otherwise(tail)


def least_bin(candidates: DataFrame, rate: float) -> DataFrame:
    """One row: the lowest bin that Benjamini-Hochberg accepts, or null.

    Counts cover all candidates (bin, random); those that are not random are never found. The
    histogram has at most 1,401 rows, so its running count is made in one task.
    """
    counts = candidates.groupBy("bin").agg(F.count("*").alias("count"), F.count_if("random").alias("passed"))
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select(
        "bin",
        F.sum("passed").over(above).alias("found"),
        F.sum("count").over(Window.partitionBy(F.lit(1))).alias("all"),
        upper_tail(F.col("bin") / BINS_PER_UNIT).alias("p"),
    )
    return ranked.where((F.col("found") > 0) & (F.col("p") * F.col("all") <= rate * F.col("found"))).agg(F.min("bin").alias("bin"))


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    columns: list[str] | None = None,
    limit: float = LIMIT,
    false_discoveries: float = FALSE_DISCOVERIES,
) -> DataFrame:
    """One row per document: ``columns`` (default: the id), n_assign, n_access, n_hex, n_random,
    base_sha256 and spans (kind:start:stop in code points). Added names replace carried ones.

    A null or empty text has no secrets; a text of any length is read whole. Equal texts get
    equal spans, repeated rows rows of their own. Spans that start together are listed by kind.
    A candidate that touches a span of a fixed pattern is not listed again. No rows give no rows.
    """
    added = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    carried = [c for c in columns or ["doc_id"] if c not in added]
    body = F.col("__text")

    def numbered(kind: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")
        ))

    assigned = F.filter(
        matches(body, ASSIGN), lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8
    )
    scanned = docs.select(*carried, F.coalesce(F.col(text), F.lit("")).alias("__text")).select(
        *carried,
        F.array_sort(F.concat(
            numbered(0, assigned), numbered(1, matches(body, ACCESS)), numbered(2, matches(body, HEX))
        )).alias("__base"),
        F.transform(matches(body, CANDIDATE), lambda s: F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), judged(s["value"]).alias("is")
        )).alias("__found"),
    )
    scanned = materialise(scanned.withColumn("__found", F.transform("__found", lambda s: F.struct(
        s["start"].alias("start"), F.lit(3).alias("kind"), s["stop"].alias("stop"),
        F.least(F.greatest(F.floor(s["is"]["ordinary"] * BINS_PER_UNIT), F.lit(-LAST_BIN)), F.lit(LAST_BIN)).cast("int").alias("bin"),
        ((s["is"]["chi"] < limit) & (F.abs(s["is"]["runs"]) < limit) & (F.abs(s["is"]["serial"]) < limit)).alias("random"),
    ))), "secrets-scanned")
    least = least_bin(scanned.select(F.explode("__found").alias("f")).select("f.bin", "f.random"), false_discoveries).scalar()
    secret = F.filter("__found", lambda s: s["random"] & (s["bin"] >= F.col("__least")) & ~F.exists(
        "__base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])
    ))
    result = scanned.withColumn("__least", least).withColumn("__more", numbered(3, secret))

    def count(kind: int) -> Column:
        return F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")

    return result.select(
        *carried,
        *(count(k).alias(name) for k, name in enumerate(added[:3])),
        F.size("__more").cast("long").alias("n_random"),
        F.sha2(listed(KINDS, F.col("__base")), 256).alias("base_sha256"),
        listed(KINDS, F.array_sort(F.concat("__base", "__more"))).alias("spans"),
    )


def op1_secrets(spark, folder: str) -> DataFrame:
    return find_secrets(table(spark, folder, "documents"))

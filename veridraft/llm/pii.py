"""Personal data: fixed patterns, and boosted trees over generously proposed spans.

Two generators propose whatever looks like an address or a number, overlapping what the fixed
patterns find. Each candidate becomes a few small features of its format and of the text
around it. Gradient-boosted trees learn from the whole corpus which combinations of features
stand for spans that the fixed patterns confirm: the corpus is reduced to counts by
combination first, so training sees every candidate and its size does not depend on them.
Scores are calibrated (isotonic) on documents kept out of training, and combinations whose
calibrated probability reaches a fixed threshold are taken wherever they occur.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridraft.llm.common import table
from veridraft.llm.spans import listed, matches
from veridraft.session import materialise

KINDS = ["email", "ip", "card", "phone", "address", "number"]
#: Possessive, and anchored where a match can start, so that time is linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

ADDRESS_LIKE = r"(?<![^\x20\x09-\x0D@])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++"
NUMBER_LIKE = r"[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9])++"
#: Digits a number-like candidate needs.
LEAST_DIGITS = 7
#: Words before a candidate that speak for it.
CUE = r"(?i)\b(?:phone|tel|call|fax|mobile|card|visa|account|e-?mail|mail|contact|ip|address|ssn)\b[^\n]*$"
CONTEXT = 24
FEATURES = ["address", "digits", "groups", "plus", "bracket", "octets", "luhn", "domain", "before", "after", "cue"]
#: Calibrated probability from which a combination of features is taken.
THRESHOLD = 0.9
#: Documents in one of so many parts are kept for calibration.
FOLDS = 5


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """13 to 19 digits whose Luhn sum ends in 0."""
    n = F.char_length(digits)
    doubled = F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(
        (n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")
    ).otherwise(F.element_at(doubled, F.substring(digits, i, F.lit(1)).cast("int") + 1)))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def fixed_spans(body: Column) -> Column:
    """Spans of the fixed patterns, by kind and then start."""
    email = matches(body, EMAIL)
    ip = F.filter(matches(body, IP), lambda s: s["value"].rlike(IP_PARTS))
    card = F.filter(matches(body, CARD), lambda s: passes_luhn(digits_of(s["value"])))
    phone = F.filter(matches(body, PHONE), lambda s: F.char_length(digits_of(s["value"])).between(9, 15))

    def numbered(kind: int, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")
        ))

    return F.concat(*(numbered(k, found) for k, found in enumerate((email, ip, card, phone))))


def _side(c: Column) -> Column:
    """0: nothing or white space, 1: letter or digit, 2: anything else."""
    return F.when(c == "", 0).when(c.rlike(r"^[\x20\x09-\x0D]"), 0).when(c.rlike(r"^[\p{L}\p{N}]"), 1).otherwise(2)


def _features(body: Column, s: Column, address: bool) -> Column:
    value = s["value"]
    digits = digits_of(value)
    n = F.char_length(digits)
    groups = F.size(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)))
    before = F.substring(body, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
    flags = {
        "address": F.lit(int(address)),
        "digits": F.when(n < 1, 0).when(n < 7, 1).when(n < 9, 2).when(n < 13, 3).when(n < 16, 4).when(n < 20, 5).otherwise(6),
        "groups": F.when(groups < 2, 0).when(groups < 4, 1).when(groups < 5, 2).otherwise(3),
        "plus": value.startswith("+"),
        "bracket": value.contains("("),
        "octets": value.rlike(IP_PARTS),
        "luhn": passes_luhn(digits),
        "domain": value.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]"),
        "before": _side(F.substring(body, s["start"], F.when(s["start"] > 0, 1).otherwise(0))),
        "after": _side(F.substring(body, s["stop"] + 1, F.lit(1))),
        "cue": before.rlike(CUE),
    }
    return F.struct(
        F.lit(4 if address else 5).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
        F.struct(*(F.coalesce(flags[f].cast("int"), F.lit(0)).alias(f) for f in FEATURES)).alias("f"),
    )


def candidates(body: Column) -> Column:
    """Proposed spans with their features."""
    numbers = F.filter(
        matches(body, NUMBER_LIKE), lambda s: F.char_length(digits_of(s["value"])) >= LEAST_DIGITS
    )
    return F.concat(
        F.transform(matches(body, ADDRESS_LIKE), lambda s: _features(body, s, True)),
        F.transform(numbers, lambda s: _features(body, s, False)),
    )


def _touch(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def probabilities(counts: DataFrame) -> DataFrame:
    """(f, p): the calibrated probability of every combination of features in ``counts``.

    ``counts`` has f, label, kept_out and n. Where one label is missing nothing is learnt and
    no row comes back.
    """
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = counts.select("f", "f.*", F.col("label").cast("double"), "kept_out", F.col("n").cast("double"))
    rows = materialise(vector.transform(rows).coalesce(1), "pii-counts")  # one row per combination
    seen = rows.groupBy("kept_out").agg(F.countDistinct("label").alias("labels")).collect()
    both = {r["kept_out"]: r["labels"] == 2 for r in seen}
    none = rows.select("f", F.lit(0.0).alias("p")).limit(0)
    if not both.get(False):
        return none
    trees = GBTClassifier(weightCol="n", maxDepth=3, maxIter=12, stepSize=0.3, seed=7)
    model = trees.fit(rows.where("NOT kept_out"))
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    scored = materialise(scored.select("f", "label", "kept_out", "n", "score"), "pii-scores")
    if both.get(True):
        steps = IsotonicRegression(featuresCol="score", weightCol="n").fit(scored.where("kept_out"))
        scored = steps.transform(scored).withColumnRenamed("prediction", "p")
    else:
        scored = scored.withColumn("p", F.col("score"))
    return scored.groupBy("f").agg(F.max("p").alias("p"))


def find_personal_data(
    docs: DataFrame, text: str = "text", columns: list[str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: ``columns`` (default: the id), n_email, n_ip, n_card, n_phone,
    n_more, base_sha256, spans (kind:start:stop in code points, by kind and then start) and
    ``found``, the spans as an array. Added names replace carried ones.

    A null or empty text has none. Equal texts get equal spans. Of learnt spans that overlap
    a fixed one none is listed, of those that overlap each other the most probable, then the
    first and longest. No rows give no rows.
    """
    added = ["n_email", "n_ip", "n_card", "n_phone", "n_more", "base_sha256", "spans", "found"]
    carried = [c for c in columns or ["doc_id"] if c not in added]
    body = F.col("__text")
    scanned = materialise(
        docs.select(*carried, F.coalesce(F.col(text), F.lit("")).alias("__text")).select(
            *carried,
            (F.pmod(F.xxhash64(body), F.lit(FOLDS)) == 0).alias("__kept_out"),
            fixed_spans(body).alias("__base"),
            candidates(body).alias("__maybe"),
        ),
        "pii-scanned",
    )
    each = scanned.select("__kept_out", "__base", F.explode("__maybe").alias("c")).select(
        F.col("c.f").alias("f"),
        F.exists("__base", lambda b: _touch(b, F.col("c"))).alias("label"),
        F.col("__kept_out").alias("kept_out"),
    )
    known = probabilities(each.groupBy("f", "label", "kept_out").agg(F.count("*").alias("n")))
    # At most one entry for each combination of the features' few values.
    taken = known.where(F.col("p") >= threshold).agg(
        F.map_from_entries(F.collect_list(F.struct("f", "p"))).alias("taken")
    ).scalar()
    likely = F.filter(
        F.transform("__maybe", lambda c: F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"),
            F.try_element_at("__taken", c["f"]).alias("p"),
        )),
        lambda c: c["p"].isNotNull() & ~F.exists("__base", lambda b: _touch(b, c)),
    )
    rank = lambda c: F.struct(c["p"], -c["start"], c["stop"])
    best = F.filter("__likely", lambda c: ~F.exists("__likely", lambda d: _touch(c, d) & (rank(d) > rank(c))))
    found = scanned.withColumn("__taken", taken).withColumn("__likely", likely)
    found = found.withColumn("__more", F.transform(best, lambda c: c.dropFields("p")))
    found = found.withColumn("__all", F.array_sort(F.concat("__base", "__more")))

    def count(kind: int) -> Column:
        return F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        *carried,
        *(count(k).alias(name) for k, name in enumerate(added[:4])),
        F.size("__more").cast("long").alias("n_more"),
        F.sha2(listed(KINDS, F.col("__base")), 256).alias("base_sha256"),
        listed(KINDS, F.col("__all")).alias("spans"),
        F.col("__all").alias("found"),
    )


def redacted(text: Column, found: Column) -> Column:
    """The text with every span of ``found`` replaced by its kind in brackets; spans that
    overlap become one, named after the first."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), (-s["stop"]).alias("less"), s["kind"].alias("kind")
    )))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(by_start, state, lambda a, s: F.struct(
        F.greatest(a["at"], -s["less"]).alias("at"),
        F.when(s["start"] < a["at"], a["parts"]).otherwise(F.concat(a["parts"], F.array(
            F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1)
        ))).alias("parts"),
    ))
    rest = F.substring(text, done["at"] + 1, F.char_length(text))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(F.array_join(done["parts"], ""), rest))


def op4_personal_data(spark, folder: str) -> DataFrame:
    return find_personal_data(table(spark, folder, "documents")).drop("found")

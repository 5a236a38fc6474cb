"""Paragraphs, claim matching and positional heatmap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridraft import domains as D
from veridraft.functions.scores import label_of
from veridraft.functions.texts import split_paragraphs, without_first
from veridraft.operators.triage import finding_visible
from veridraft.session import materialise

#: Audits with at most this many different claim prefixes carry them as one small array.
SMALL_AUDIT_PREFIXES = 16
#: Longer paragraphs are cut up before they are searched.
SEGMENT_CHARS = 10_000
#: Longest gram in bytes that finds a prefix, and 64-bit words of an audit's filter at most.
GRAM_BYTES, FILTER_WORDS = 16, 1 << 14
#: Odd factors of the rolling hash.
FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def paragraphs(documents: DataFrame, key: str, text: str, separator: str = "\n\n") -> DataFrame:
    """A57. (key, para_no from 1, para). Stays in the scan stage: no shuffle."""
    return documents.select(
        key, F.posexplode(split_paragraphs(F.col(text), separator)).alias("para_no", "para")
    ).withColumn("para_no", F.col("para_no") + 1)


def claim_prefix(claim: Column, chars: int = D.CLAIM_PREFIX_CHARS) -> Column:
    """Lower-cased beginning of a claim."""
    return F.substring(F.lower(claim), 1, chars)


def segments(text: Column, overlap: int, size: int = SEGMENT_CHARS) -> Column:
    """A long text in pieces of ``size`` characters that overlap by ``overlap``, so that any
    string of up to ``overlap`` + 1 characters lies inside one of them."""
    pattern = F.lit(f"(?s)(.{{1,{size}}})(?=(.{{0,{overlap}}}))")
    pieces = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(1)),
        F.regexp_extract_all(text, pattern, F.lit(2)),
        lambda body, rest: F.concat(body, rest),
    )
    return F.when(F.length(text) <= size, F.array(text)).otherwise(pieces)


def gram_bytes(length: np.ndarray) -> np.ndarray:
    """Length of the gram that anchors a prefix: the largest power of two that fits, up to ``GRAM_BYTES``."""
    return np.left_shift(1, np.log2(np.clip(length, 1, GRAM_BYTES)).astype(np.int64))


def gram_hashes(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the gram of this length that begins at each byte) for 1, 2, 4 ... ``GRAM_BYTES``."""
    size, hashes = 1, (data.astype(np.uint64) + np.uint64(1)) * FACTORS[0]
    while True:
        mixed = (hashes ^ hashes >> np.uint64(32)) * FACTORS[1]
        yield size, mixed ^ mixed >> np.uint64(29)
        if size == GRAM_BYTES:
            return
        rest = np.zeros_like(hashes)
        rest[:-size] = hashes[size:]
        hashes = (hashes ^ hashes >> np.uint64(31)) * FACTORS[0] + rest
        size *= 2


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, where each row ends, the row of each byte) of a column of texts."""
    column = pa.concat_arrays([column.cast(pa.binary())])
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and ends[-1] > ends[0] else np.empty(0, np.uint8)
    return data, ends[1:] - ends[0], np.repeat(np.arange(len(column)), np.diff(ends))


def _once(rows: list[np.ndarray], hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal pairs once, ordered."""
    row, hashed = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    return row[new], hashed[new].view(np.int64)


def _prefix_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., prefix) with gram and hashes: of all grams of this length in the prefix."""
    for batch in batches:
        data, ends, row = _bytes_of(batch.column("prefix"))
        grams = gram_bytes(np.diff(ends, prepend=0))
        rows, found = [], []
        for size, hashes in gram_hashes(data):
            at = np.flatnonzero((grams[row] == size) & (np.arange(len(data)) + size <= ends[row]))
            rows.append(row[at])
            found.append(hashes[at])
        row, hashed = _once(rows, found)
        offsets = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(grams.astype(np.int32)), lists], [*batch.schema.names, "gram", "hashes"]
        )


def anchors(prefixes: DataFrame, key: str) -> DataFrame:
    """(key, prefix, hit, gram, hash): each prefix with the hash of the gram that the fewest prefixes of
    its audit hold, so that a text position leads to as few of them as possible.

    Audits without a gram in two prefixes take any; only the others count each prefix's grams.
    """
    rows = prefixes.select(key, "prefix", "hit")
    schema = T.StructType([*rows.schema, T.StructField("gram", T.IntegerType()), T.StructField("hashes", T.ArrayType(T.LongType()))])
    grams = rows.mapInArrow(_prefix_grams, schema)
    held = grams.select(key, F.explode("hashes").alias("hash")).groupBy(key, "hash").agg(F.count(F.lit(1)).alias("_held"))
    shared = materialise(held.where(F.col("_held") > 1), "shared-grams")
    audits = shared.select(key).distinct()
    alone = grams.join(audits, key, "left_anti").select(key, "prefix", "hit", "gram", F.get("hashes", F.lit(0)).alias("hash"))
    each = grams.join(audits, key, "left_semi").select(key, "prefix", "hit", "gram", F.explode("hashes").alias("hash"))
    rarest = F.min(F.struct(F.coalesce("_held", F.lit(1)).alias("_held"), "hash", "gram", "hit")).alias("a")
    counted = each.join(shared, [key, "hash"], "left").groupBy(key, "prefix").agg(rarest)
    return alone.unionByName(counted.select(key, "prefix", "a.hit", "a.gram", "a.hash"))


def anchor_filters(found: DataFrame, key: str) -> DataFrame:
    """(key, _grams, _bits): gram lengths in use, added up, and two bits in one word for each anchor of an audit.

    ``_bits`` has 32 bits or more per prefix and ``FILTER_WORDS`` words at most; with more
    prefixes than that more positions pass, and the join sorts them out.
    """
    words = F.least(F.lit(FILTER_WORDS), F.expr("shiftleft(1, cast(ceil(log2(greatest(_n, 2))) as int) - 1)"))
    sizes = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.bit_or("gram").alias("_grams")).select(
        key, "_grams", words.alias("_words")
    )
    bit = "shiftleft(1L, cast(shiftrightunsigned(hash, {}) & 63 as int))"
    bits = (
        found.join(sizes, key)
        .groupBy(key, "_grams", "_words", F.expr("cast(shiftrightunsigned(hash, 12) & (_words - 1) as int)").alias("_word"))
        .agg(F.expr(f"bit_or({bit.format(0)} | {bit.format(6)})").alias("_set"))
        .groupBy(key, "_grams", "_words")
        .agg(F.map_from_entries(F.collect_list(F.struct("_word", "_set"))).alias("_m"))
    )
    every = F.expr("transform(sequence(0, _words - 1), i -> coalesce(_m[i], 0L))")
    return bits.select(key, "_grams", every.alias("_bits"))


def _anchor_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., _text, _grams, _bits) to (..., hash): the grams of each text that pass its filter."""
    for batch in batches:
        data, ends, row = _bytes_of(batch.column("_text"))
        wanted = batch.column("_grams").to_numpy()
        bits, words = batch.column("_bits").flatten().to_numpy().view(np.uint64), batch.column("_bits").value_lengths().to_numpy()
        first = np.cumsum(words) - words
        rows, found = [], []
        for size, hashes in gram_hashes(data):
            if not (wanted & size).any():
                continue
            at = np.flatnonzero((wanted & size > 0)[row] & (np.arange(len(data)) + size <= ends[row]))
            hashed, its = hashes[at], row[at]
            word = bits[first[its] + ((hashed >> np.uint64(12)).astype(np.int64) & words[its] - 1)]
            held = word >> (hashed & np.uint64(63)) & word >> (hashed >> np.uint64(6) & np.uint64(63)) & np.uint64(1)
            rows.append(its[held > 0])
            found.append(hashed[held > 0])
        if rows:
            row, hashed = _once(rows, found)
            kept = [c for c in batch.schema.names if c not in ("_text", "_grams", "_bits")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in kept), pa.array(hashed)], [*kept, "hash"])


def match_paragraphs(
    paras: DataFrame,
    flags: DataFrame,
    key: str = "audit_id",
    prefix_chars: int = D.CLAIM_PREFIX_CHARS,
    small: int = SMALL_AUDIT_PREFIXES,
) -> DataFrame:
    """A56. (key, para_no, flag_id): the first flag, in array order, whose claim prefix the
    paragraph contains. Paragraphs without a match are left out. An empty claim matches all.

    Flags are first reduced to one row per different prefix (the lowest ``ord`` wins).
    Audits with few prefixes test them in place against an array of at most ``small``
    entries. In audits with many prefixes each prefix is found through one gram of it, its
    anchor: a rolling hash passes over the bytes of the text, a position whose hash passes the
    audit's filter leaves it, and equal hashes are joined. Every pair is verified in the text. So a
    paragraph never meets all flags, prefixes of any lengths cost one hash per position and
    gram length (five at most), and a very large audit is spread over many tasks. The prefixes
    and their anchors are written once.
    """
    first = materialise(
        flags.withColumn("prefix", claim_prefix(F.col("claim"), prefix_chars))
        .where("prefix IS NOT NULL")
        .groupBy(key, "prefix")
        .agg(F.min(F.struct("ord", "flag_id")).alias("hit")),
        "claim-prefixes",
    )
    sizes = first.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("prefix") == "", F.col("hit"))).alias("_always")
    )
    few, many = sizes.where(F.col("_n") <= small), sizes.where(F.col("_n") > small)
    prefixes = (
        first.join(few.select(key), key, "left_semi")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("hit", "prefix"))).alias("_prefixes"))
    )
    text = F.lower("para")
    in_place = F.get(F.filter("_prefixes", lambda p: F.contains(text, p["prefix"])), F.lit(0))["hit"]
    hits = paras.join(prefixes, key).select(key, "para_no", in_place.alias("hit")).where("hit IS NOT NULL")
    always = many.where("_always IS NOT NULL").select(key, F.col("_always").alias("hit"))
    hits = hits.unionByName(paras.join(always, key).select(key, "para_no", "hit"))

    found = materialise(
        anchors(first.where("prefix <> ''").join(many.select(key), key, "left_semi"), key), "claim-anchors"
    )
    pieces = paras.select(key, "para_no", F.posexplode(segments(text, prefix_chars - 1)).alias("_piece", "_text"))
    place = [pieces.schema[c] for c in (key, "para_no", "_piece")]
    met = (
        pieces.join(anchor_filters(found, key), key)
        .select(key, "para_no", "_piece", "_text", "_grams", "_bits")
        .mapInArrow(_anchor_places, T.StructType([*place, T.StructField("hash", T.LongType())]))
        .join(found.drop("gram"), [key, "hash"])
        .drop("hash")
    )
    held = met.join(pieces, [key, "para_no", "_piece"]).where(F.contains("_text", F.col("prefix")))
    return (
        hits.unionByName(held.select(key, "para_no", "hit"))
        .groupBy(key, "para_no")
        .agg(F.min("hit").alias("hit"))
        .select(key, "para_no", F.col("hit.flag_id").alias("flag_id"))
    )


def clean_paragraphs(paras: DataFrame, matches: DataFrame, key: str = "audit_id") -> DataFrame:
    """A58. Paragraphs no flag matches."""
    return paras.join(matches.select(key, "para_no"), [key, "para_no"], "left_anti")


def paragraph_view(
    paras: DataFrame,
    matches: DataFrame,
    flags: DataFrame,
    selection: DataFrame | None = None,
    finding: str = "ALL",
    key: str = "audit_id",
) -> DataFrame:
    """A59, A60. Every paragraph with its flag, remaining text, visibility and selection."""
    shown = flags.select(
        key, "flag_id", "claim", "severity",
        F.coalesce(finding_visible(finding), F.lit(False)).alias("_visible"),
    )
    view = paras.join(matches, [key, "para_no"], "left").join(shown, [key, "flag_id"], "left")
    if selection is None:
        view = view.withColumn("_selected", F.lit(None).cast("string"))
    else:
        view = view.join(selection.select(key, F.col("flag_id").alias("_selected")), key, "left")
    matched = F.col("flag_id").isNotNull()
    return view.select(
        key,
        "para_no",
        "flag_id",
        "severity",
        F.when(matched, without_first(F.col("para"), F.col("claim"))).otherwise(F.col("para")).alias("shown_text"),
        (~matched).alias("is_clean"),
        # a flag id that is not in the table stays visible
        (F.coalesce("_visible", F.lit(True))).alias("is_visible"),
        F.coalesce(F.col("flag_id") == F.col("_selected"), F.lit(False)).alias("is_selected"),
    )


def is_dynamic(audits: DataFrame, flags: DataFrame) -> DataFrame:
    """A61. audits(audit_id, raw_text): whether the text itself is shown, marked up."""
    first = flags.where("ord = 0").select("audit_id", F.col("claim").alias("_claim"))
    return audits.join(first, "audit_id", "left").select(
        "audit_id",
        F.coalesce(
            F.contains("raw_text", F.lit(D.DYNAMIC_TEXT_MARKER)) & (F.col("_claim") != ""), F.lit(False)
        ).alias("is_dynamic"),
    )


def heatmap(
    audits: DataFrame,
    flags: DataFrame,
    sections: int = D.HEATMAP_SECTIONS,
    selection: DataFrame | None = None,
) -> DataFrame:
    """A62. ``sections`` rows per audit; section i shows the i-th flag.

    Later flags are not shown. A section whose only flag is INFORMATIONAL has severity CLEAN
    but is not ``is_clean``. ``ord`` is an array position, so a section has one flag at most;
    only flags with a small ``ord`` are shuffled.
    """
    cells = audits.select("audit_id", F.explode(F.sequence(F.lit(1), F.lit(sections))).alias("section"))
    shown = flags.where(F.col("ord") < sections).select(
        "audit_id", (F.col("ord") + 1).alias("section"), "flag_id", F.col("severity").alias("_severity")
    )
    if selection is None:
        shown = shown.withColumn("_selected", F.lit(False))
    else:
        marked = selection.select("audit_id", "flag_id", F.lit(True).alias("_selected"))
        shown = shown.join(marked, ["audit_id", "flag_id"], "left")
    ranked = F.col("_severity").isin("CRITICAL", "HIGH", "MEDIUM", "LOW")
    severity = F.when(ranked, F.col("_severity")).otherwise("CLEAN")
    is_clean = F.col("flag_id").isNull()
    return cells.join(shown, ["audit_id", "section"], "left").select(
        "audit_id",
        "section",
        "flag_id",
        severity.alias("severity"),
        is_clean.alias("is_clean"),
        F.coalesce("_selected", F.lit(False)).alias("has_selected"),
        label_of(severity, "heatmap").alias("label"),
        F.when(is_clean, "clean").otherwise("1 issue").alias("count_text"),
    )

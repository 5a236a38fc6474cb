"""From documents to verdicts, flags and inputs of the score (E3): B04, B05, B06, B08, B09."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridraft.functions.columns import mapped
from veridraft.operators.canonical import canonical_stream, extract_claims
from veridraft.operators.evidence import source_precedence
from veridraft.operators.retrieval import bm25_top_k, build_index, words
from veridraft.operators.verdicts import claim_verdicts, parse_amount, parse_day
from veridraft.session import materialise

#: What a verdict costs: (severity, impact). Supported claims raise no flag.
FINDINGS = {"CONTRADICTED": ("CRITICAL", -10), "UNSUPPORTED": ("MEDIUM", -3), "UNCERTAIN": ("LOW", -1)}

#: Characters on either side of a value whose words say what it is about.
CONTEXT_CHARS = 24


def typed_values(claims: DataFrame) -> DataFrame:
    """Add kind, amount and day to rows with category and value."""
    numeric = F.col("category").isin("COMMERCIAL_VALUE", "SLA_GUARANTEE")
    return claims.withColumns({
        "kind": F.col("category"),
        "amount": F.when(numeric, parse_amount(F.col("value"))),
        "day": F.when(F.col("category") == "DELIVERY_DATE", parse_day(F.col("value"))),
    })


def document_claims(documents: DataFrame, key: str, text: str) -> DataFrame:
    """B04, B05. Typed claims of every document; ``claim_id`` is key-sentence-value."""
    found = extract_claims(canonical_stream(documents, key, F.col(text)), key)
    return typed_values(found).withColumn("claim_id", F.concat_ws("-", key, "sentence_no", "value_no"))


def value_context(sentence: Column, value: Column, chars: int = CONTEXT_CHARS) -> Column:
    """The different words within ``chars`` characters of a value's first place in its sentence."""
    at = F.instr(sentence, value)
    before = F.substring(sentence, F.greatest(F.lit(1), at - chars), F.least(F.lit(chars), at - 1))
    after = F.substring(sentence, at + F.length(value), F.lit(chars))
    return F.array_distinct(words(F.concat(before, F.lit(" "), after)))


def aligned_values(values: DataFrame, hits: DataFrame, stated: DataFrame, source_key: str) -> DataFrame:
    """B09. (sentence_key, value_no, source, kind, amount, day): the value of a passage that a claimed one is about.

    values(sentence_key, value_no, category, context), hits(sentence_key, source),
    stated(source, sentence_no, value_no, category, context, kind, amount, day).

    The values that a sentence claims and those of the same category that a passage states are
    matched one to one: the pair with most common words in their contexts first, ties in the
    order of the text. A value that shares no word with what is left has no partner there.
    """
    left = values.select("sentence_key", "category", F.col("value_no").alias("claimed"), "context")
    right = stated.select(
        source_key, "category", "sentence_no", "value_no", F.col("context").alias("_context"), "kind", "amount", "day"
    )
    pairs = left.join(hits, "sentence_key").join(right, [source_key, "category"]).withColumn(
        "common", F.size(F.array_intersect("context", "_context"))
    ).where("common > 0")
    order = F.struct((-F.col("common")).alias("rank"), "claimed", "sentence_no", "value_no", "kind", "amount", "day")
    # The pairs of one sentence and one passage: as many as their values, at most.
    listed = pairs.groupBy("sentence_key", source_key, "category").agg(F.array_sort(F.collect_list(order)).alias("p"))

    def taken(chosen: Column, pair: Column) -> Column:
        return F.exists(chosen, lambda c: (c["claimed"] == pair["claimed"]) | (
            (c["sentence_no"] == pair["sentence_no"]) & (c["value_no"] == pair["value_no"])
        ))

    matched = F.aggregate(
        "p", F.filter("p", lambda x: F.lit(False)),
        lambda chosen, x: F.when(taken(chosen, x), chosen).otherwise(F.concat(chosen, F.array(x))),
    )
    return listed.select("sentence_key", source_key, F.explode(matched).alias("m")).select(
        "sentence_key", F.col("m.claimed").alias("value_no"), source_key, "m.kind", "m.amount", "m.day"
    )


def audit_claims(claims: DataFrame, sources: DataFrame, source_key: str, text: str, k: int = 3) -> DataFrame:
    """B06, B08, B09. Verdicts on claims(claim_id, value_no, category, value, sentence, kind, amount, day).

    sources(source_key, text, authority, freshness_date): each claim's sentence retrieves its
    ``k`` best passages; of those that state a value the claim can be about (see
    ``aligned_values``) the highest in precedence is the truth. The claims are written once;
    equal sentences retrieve and are matched once.
    """
    keys = ["sentence_key", "value_no"]
    context = value_context(F.col("sentence"), F.col("value")).alias("context")
    claims = materialise(claims.withColumn("sentence_key", F.md5("sentence")), "claims")
    index = build_index(sources, source_key, text)
    asked = claims.groupBy("sentence_key").agg(F.first("sentence").alias("sentence"))
    hits = bm25_top_k(asked, index, k, "sentence_key", "sentence").select("sentence_key", source_key)
    values = claims.select(*keys, "category", context).dropDuplicates(keys)
    stated = document_claims(sources, source_key, text).withColumn("context", context)
    candidates = aligned_values(values, hits, stated, source_key).join(
        sources.select(source_key, "authority", "freshness_date"), source_key
    ).withColumnRenamed(source_key, "source_id")
    truths = source_precedence(candidates, keys)
    return claim_verdicts(claims, truths, keys).join(truths.select(*keys, "source_id"), keys, "left").drop("sentence_key")


def verdict_flags(verdicts: DataFrame, key: str, audit_id) -> DataFrame:
    """Flags of all claims that are not supported; ``audit_id`` names a document's audit."""
    raised = verdicts.where(F.col("verdict").isin(*FINDINGS))
    return raised.select(
        audit_id.alias("audit_id"),
        F.concat(F.lit("FLG-"), "claim_id").alias("flag_id"),
        "claim_id",
        mapped(F.col("verdict"), {v: s for v, (s, _) in FINDINGS.items()}).alias("severity"),
        mapped(F.col("verdict"), {v: i for v, (_, i) in FINDINGS.items()}).cast("int").alias("impact_score"),
        F.lit("PENDING").alias("status"),
        "source_id",
    )

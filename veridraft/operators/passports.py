"""Passport verification and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridraft import domains as D


def verify_passports(requests: DataFrame, passports: DataFrame) -> DataFrame:
    """A70. Outcome per requested token. The passport's own status is not looked at.

    Rules in order: too short or missing; tampered by prefix; invalid by prefix; unknown;
    else verified. Only tokens that can match take part in the join (A54).
    """
    token = F.col("token")
    usable = (
        token.isNotNull()
        & (F.length(token) >= D.MIN_TOKEN_LENGTH)
        & ~F.startswith(token, F.lit(D.TAMPER_PREFIX))
        & ~F.startswith(token, F.lit(D.INVALID_PREFIX))
    )
    known = passports.select(
        F.col("token").alias("_token"), F.col("unresolved_flags_count").alias("_unresolved")
    )
    outcome = (
        F.when(token.isNull() | (F.length(token) < D.MIN_TOKEN_LENGTH), "INVALID")
        .when(F.startswith(token, F.lit(D.TAMPER_PREFIX)), "TAMPERED")
        .when(F.startswith(token, F.lit(D.INVALID_PREFIX)) | F.col("_token").isNull(), "INVALID")
        .otherwise("VERIFIED")
    )
    too_short = token.isNull() | (F.length(token) < D.MIN_TOKEN_LENGTH)
    joined = requests.join(known, usable & (token == F.col("_token")), "left")
    return joined.withColumn("outcome", outcome).select(
        *requests.columns,
        (F.col("outcome") == "VERIFIED").alias("valid"),
        "outcome",
        F.when(F.col("outcome") == "TAMPERED", D.TAMPER_MESSAGE)
        .when((F.col("outcome") == "INVALID") & ~too_short, D.INVALID_MESSAGE)
        .alias("error_message"),
        F.when(F.col("outcome") == "VERIFIED", F.col("_unresolved")).alias("unresolved_flags"),
    )


def verification_trail(verified: DataFrame) -> DataFrame:
    """A71. One row per check of each outcome; invalid tokens have none."""

    def step(name, status, detail) -> Column:
        as_col = [x if isinstance(x, Column) else F.lit(x) for x in (name, status, detail)]
        return F.struct(as_col[0].alias("step"), as_col[1].alias("status"), as_col[2].alias("detail"))

    unresolved = F.col("unresolved_flags")
    anchor = step(
        D.RECONCILIATION_STEP,
        F.when(unresolved > 0, "WARN").otherwise("PASS"),
        F.concat(unresolved.cast("string"), F.lit(D.RECONCILIATION_DETAIL)),
    )
    trail = F.when(
        F.col("outcome") == "TAMPERED", F.array(*[step(*s) for s in D.TRAIL_TAMPERED])
    ).when(F.col("outcome") == "VERIFIED", F.array(*[step(*s) for s in D.TRAIL_VERIFIED], anchor))
    return verified.select("token", F.posexplode(trail).alias("step_no", "s")).select(
        "token", (F.col("step_no") + 1).alias("step_no"), "s.*"
    )


def check_digests(documents: DataFrame, stated: DataFrame, key: str, text: str = "text") -> DataFrame:
    """B10. Recompute document digests; a different stated digest means tampering.

    stated(key, document_hash) with or without the ``sha256:`` prefix.
    """
    actual = documents.select(key, F.sha2(F.encode(text, "utf-8"), 256).alias("actual_hash"))
    return stated.join(actual, key).select(
        key,
        "actual_hash",
        (F.regexp_replace("document_hash", "^sha256:", "") != F.col("actual_hash")).alias("is_tampered"),
    )


def _fold(items: Column) -> Column:
    """h <- sha256(h || item) over an array, starting from ''."""
    return F.aggregate(items, F.lit(""), lambda h, x: F.sha2(F.concat(h, x).cast("binary"), 256))


def claim_root(claims: DataFrame, key: str, number: str, text: str, fan_out: int = 1024, levels: int = 7) -> DataFrame:
    """B10. Digest root over the claims of each audit in claim-number order.

    One definition for every size: blocks of ``fan_out`` consecutive numbers are chained
    (h <- sha256(h || x)), the block digests are chained in the same way, and so on, always
    ``levels`` times, also where a single block is left. Seven levels of 1,024 cover every
    BIGINT number. No array is longer than ``fan_out``. Numbers start at 1 and are unique in
    an audit.
    """
    if fan_out < 2:
        raise ValueError("fan_out must be at least 2")
    rows = claims.select(key, (F.col(number).cast("bigint") - 1).alias("n"), F.col(text).alias("x"))
    for _ in range(levels):
        gathered = rows.groupBy(key, F.floor(F.col("n") / fan_out).cast("bigint").alias("b")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("xs")
        )
        rows = gathered.select(key, F.col("b").alias("n"), _fold(F.col("xs")).alias("x"))
    return rows.select(key, F.col("x").alias("claim_tree_root"))


def check_claim_roots(claims: DataFrame, stated: DataFrame, key: str, number: str, text: str, **kw) -> DataFrame:
    """B10. stated(key, claim_tree_root) against the recomputed root."""
    roots = claim_root(claims, key, number, text, **kw).withColumnRenamed("claim_tree_root", "actual_root")
    return stated.join(roots, key, "left").select(
        key,
        "actual_root",
        F.coalesce(
            F.regexp_replace("claim_tree_root", "^sha256chain:", "") != F.col("actual_root"), F.lit(True)
        ).alias("is_tampered"),
    )

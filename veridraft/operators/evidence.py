"""Evidence, sources, graph, policies and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft import domains as D
from veridraft.functions.columns import audit_key, mapped, or_default
from veridraft.functions.scores import infer_verdict, severity_of_rank, severity_rank
from veridraft.functions.texts import format_location, non_blank


def evidence_view(flags: DataFrame) -> DataFrame:
    """A25. What the evidence panel shows for each flag."""
    evidence = F.col("evidence")
    return flags.select(
        "audit_id",
        "flag_id",
        infer_verdict(F.col("verification_status"), F.col("severity")).alias("verdict"),
        non_blank(evidence["quote"]).alias("has_quote"),
        or_default(evidence["authority"], D.DEFAULT_EVIDENCE_AUTHORITY).alias("authority"),
        or_default(evidence["authority"], evidence["source_name"]).alias("card_authority"),
        or_default(evidence["freshness_date"], D.DEFAULT_FRESHNESS).alias("freshness"),
        F.round(evidence["relevance_score"] * 100).cast("int").alias("relevance_percent"),
        format_location(evidence["document_location"]).alias("location_text"),
        F.when(
            F.col("counter_evidence").isNotNull(),
            F.when(F.col("verification_status") == "CONTRADICTED", "CONTRADICTING").otherwise("UNCERTAIN"),
        ).alias("counter_relation"),
    )


def evidence_source(flags: DataFrame, sources: DataFrame, mode: str = "first") -> DataFrame:
    """A51. Source document shown for each flag.

    ``first`` (what the workspace does) takes the audit's first source; ``cited`` takes the
    one the evidence names. The planner broadcasts ``sources`` only while it is small.
    """
    if mode == "first":
        first = sources.where("ord = 0").drop("ord")
        return flags.drop("source_id").join(first, "audit_id", "left")
    return flags.join(sources.drop("ord"), ["audit_id", "source_id"], "left")


def checklist_flags(items: DataFrame, flags: DataFrame) -> DataFrame:
    """A52. Check items with the flag they point at (NULL columns if it is gone)."""
    target = flags.select(
        "audit_id", "flag_id",
        F.col("severity").alias("flag_severity"),
        F.col("status").alias("flag_status"),
        F.lit(True).alias("_hit"),
    )
    return items.join(target, ["audit_id", "flag_id"], "left").withColumn(
        "has_flag", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def evidence_graph(audits: DataFrame, claims: DataFrame, flags: DataFrame) -> DataFrame:
    """A55. Edge list: document -> claim for every claim, claim -> source for every flag
    that cites one ("Contradicts" edges)."""
    document = claims.join(audits.select("audit_id", "document_name"), "audit_id").select(
        "audit_id",
        F.concat(F.lit("doc:"), "document_name").alias("src"),
        F.concat(F.lit("claim:"), "claim_id").alias("dst"),
        F.lit(None).cast("string").alias("label"),
    )
    cited = flags.where("source_id IS NOT NULL AND claim_id IS NOT NULL").select(
        "audit_id",
        F.concat(F.lit("claim:"), "claim_id").alias("src"),
        F.concat(F.lit("source:"), "source_id").alias("dst"),
        F.concat(F.lit("Contradicts "), F.coalesce("source_name", "source_id")).alias("label"),
    )
    return document.unionByName(cited)


def location_heatmap(flags: DataFrame) -> DataFrame:
    """B03. Findings per place in the document (page, paragraph, sheet or text).

    ``flags`` carries ``document_location``. The ids behind a place are rows of
    ``location_flags``: a crowded place is never collected into one array.
    """
    return flags.groupBy("audit_id", place_of(F.col("document_location")).alias("place")).agg(
        F.count(F.lit(1)).alias("finding_count"),
        severity_of_rank(F.min(severity_rank(F.col("severity")))).alias("worst_severity"),
    )


def location_flags(flags: DataFrame) -> DataFrame:
    """B03. (audit, place, flag) rows behind the heatmap."""
    return flags.select(
        "audit_id", place_of(F.col("document_location")).alias("place"), "flag_id", "severity"
    )


def place_of(location):
    return (
        F.when(location["type"] == "pdf", F.concat(F.lit("page "), location["page"].cast("string")))
        .when(location["type"] == "docx", F.concat(F.lit("paragraph "), location["paragraph"].cast("string")))
        .when(location["type"] == "xlsx", F.concat(F.lit("sheet "), location["sheet"]))
        .when(location["type"] == "text", F.lit("text"))
        .otherwise("unknown")
    )


def source_precedence(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """B08. The winning source per claim: authority order, then freshest, then lowest id.

    candidates(keys.., source_id, authority, freshness_date). One aggregation with partial
    results instead of a sort inside each claim.
    """
    order = F.coalesce(
        mapped(F.col("authority"), {a: i for i, a in enumerate(D.AUTHORITY_ORDER)}), F.lit(99)
    )
    rank = F.struct(
        order.alias("authority_rank"),
        F.coalesce(-F.unix_date(F.col("freshness_date").cast("date")), F.lit(2147483647)).alias("age"),
        F.col("source_id"),
    )
    rest = [c for c in candidates.columns if c not in (*keys, "source_id", "authority_rank")]
    return (
        candidates.withColumn("_r", F.struct(rank.alias("rank"), *rest))
        .groupBy(*keys)
        .agg(F.min("_r").alias("_w"), F.count(F.lit(1)).alias("candidates"))
        .select(
            *keys, F.col("_w.rank.source_id").alias("source_id"),
            F.col("_w.rank.authority_rank").alias("authority_rank"),
            *[F.col(f"_w.{c}").alias(c) for c in rest], "candidates",
        )
    )


POLICY_STATUSES = ("VIOLATED", "AT_RISK", "COMPLIANT", "NOT_CONFIGURED", "EVALUATION_FAILED")


def policy_rollup(flags: DataFrame) -> DataFrame:
    """B11. Findings per policy and status, with the worst status seen."""
    rows = flags.select(F.explode("policy_findings").alias("p"))
    status = F.col("p.policy_status")
    rank = F.coalesce(mapped(status, {s: i for i, s in enumerate(POLICY_STATUSES)}), F.lit(99))
    return rows.groupBy(F.col("p.policy_name").alias("policy_name")).agg(
        *[F.count_if(status == s).alias(f"n_{s.lower()}") for s in POLICY_STATUSES],
        mapped(F.min(rank), dict(enumerate(POLICY_STATUSES))).alias("worst_status"),
    )


def omission_rollup(flags: DataFrame) -> DataFrame:
    """B11. Omissions per confidence, and how many need a human."""
    rows = flags.select(F.explode("omission_findings").alias("o"))
    return rows.groupBy(F.col("o.confidence").alias("confidence")).agg(
        F.count(F.lit(1)).alias("omissions"),
        F.count_if("o.requires_human_review").alias("need_review"),
    )


def integrity_report(
    audits: DataFrame, claims: DataFrame, flags: DataFrame, items: DataFrame
) -> DataFrame:
    """B13. Broken references and wrong stated counts.

    Kinds: FLAG_WITHOUT_CLAIM, ITEM_WITHOUT_FLAG, FINDINGS_COUNT.
    """
    no_claim = (
        flags.where("claim_id IS NOT NULL")
        .join(claims.select("audit_id", "claim_id"), ["audit_id", "claim_id"], "left_anti")
        .select(
            F.lit("FLAG_WITHOUT_CLAIM").alias("kind"), "audit_id", F.col("flag_id").alias("item_id"),
            F.col("claim_id").alias("detail"),
        )
    )
    no_flag = items.join(flags.select("audit_id", "flag_id"), ["audit_id", "flag_id"], "left_anti").select(
        F.lit("ITEM_WITHOUT_FLAG").alias("kind"), "audit_id", "item_id", F.col("flag_id").alias("detail")
    )
    actual = flags.groupBy("audit_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = (
        audits.join(actual, "audit_id", "left")
        .withColumn("_n", F.coalesce("_n", F.lit(0).cast("bigint")))
        .where("findings_count <> _n")
        .select(
            F.lit("FINDINGS_COUNT").alias("kind"), "audit_id", F.col("audit_id").alias("item_id"),
            F.concat(
                F.lit("stated "), F.col("findings_count").cast("string"),
                F.lit(", actual "), F.col("_n").cast("string"),
            ).alias("detail"),
        )
    )
    return no_claim.unionByName(no_flag).unionByName(counts)


def get_passport(audit_ids: DataFrame, passports: DataFrame) -> DataFrame:
    """A53. Passport per requested audit id (any case); the first one in key order.

    Audits without a passport get stand-in values, marked ``is_fallback``. The original
    makes up a token, root and signature for those; here the token is derived from the
    audit id and the others stay NULL.
    """
    columns = [c for c in passports.columns if c not in ("ord", "audit_id")]
    first = passports.groupBy(audit_key(F.col("audit_id")).alias("_k")).agg(
        F.min_by(F.struct(*columns), "ord").alias("p")
    )
    standin = D.STANDIN_PASSPORT
    fallback = {
        "token": F.concat(F.lit("PASSPORT-00000-"), F.col("audit_id")),
        "document_hash": F.concat(F.lit("sha256:"), F.sha2(F.lit("").cast("binary"), 256)),
        **{k: F.lit(v) for k, v in standin.items()},
    }
    return (
        audit_ids.withColumn("_k", audit_key(F.col("audit_id")))
        .join(first, "_k", "left")
        .select(
            "audit_id",
            *[
                F.when(F.col("p").isNull(), fallback.get(c, F.lit(None)))
                .otherwise(F.col(f"p.{c}")).alias(c)
                for c in columns
            ],
            F.col("p").isNull().alias("is_fallback"),
        )
    )


"""Reading, listing and creating audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridraft import domains as D
from veridraft import schemas
from veridraft.functions import texts
from veridraft.functions.columns import audit_key, or_default
from veridraft.functions.scores import label_of


def load_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A01. Read one of the tables in ``schemas.TABLES`` (parquet, json, orc, ...)."""
    return spark.read.schema(schemas.TABLES[name]).format(fmt).load(path)


def load_audits(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A01."""
    return load_table(spark, "audits", path, fmt)


def write_table(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Sink for any of the tables; audits and children are appended."""
    df.write.mode(mode).format(fmt).save(path)


def list_audits(audits: DataFrame) -> DataFrame:
    """A02. Newest first."""
    return audits.orderBy(F.desc("seq"))


def _stored_key(table: DataFrame):
    """The stored key, which scans can filter by, or the one computed from the id."""
    return F.col("audit_key") if "audit_key" in table.columns else audit_key(F.col("audit_id"))


def with_key(rows: DataFrame) -> DataFrame:
    """Rows with the stored key."""
    return rows.withColumn("audit_key", audit_key(F.col("audit_id")))


def get_audit(audits: DataFrame, audit_id: str, strict: bool = True) -> DataFrame:
    """A03. One audit by case-insensitive id.

    ``strict`` makes the result fail when it is evaluated and the id is unknown. With a
    stored ``audit_key`` column the filter is pushed to the scan.
    """
    found = audits.where(_stored_key(audits) == audit_id.lower())
    if not strict:
        return found
    first, *rest = found.columns
    missing = (
        found.agg(F.count(F.lit(1)).alias("_n"))
        .where("_n = 0")
        .select(
            F.raise_error(F.lit(f"Audit not found: {audit_id}"))
            .cast(found.schema[first].dataType)
            .alias(first),
            *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in rest],
        )
    )
    return found.unionByName(missing)


def children_of(audits: DataFrame, child: DataFrame, audit_id: str, order: str = "ord") -> DataFrame:
    """A04. Claims, flags, sources ... of one audit in array order."""
    wanted = get_audit(audits, audit_id, strict=False).select(
        audit_key(F.col("audit_id")).alias("_key")
    )
    mine = child.where(_stored_key(child) == audit_id.lower())
    return (
        mine.join(wanted, audit_key(mine["audit_id"]) == F.col("_key"), "left_semi")
        .orderBy(order)
    )


def create_audits(
    submissions: DataFrame, files: DataFrame, template: dict | None = None
) -> dict[str, DataFrame]:
    """A05. New audits from submissions, as one DataFrame per table to append.

    submissions(seq, audit_id, title, document_type, language, file_name, file_size, ts)
    files(audit_id, ord, source_id, name, size, authority, hash): the source files
    ``template`` overrides the seeded constants in ``domains.NEW_AUDIT``.
    """
    t = {**D.NEW_AUDIT, **(template or {})}
    lit = F.lit
    numeric = F.col("file_size").rlike(r"^\d+$")
    audits = submissions.select(
        "seq",
        "audit_id",
        texts.title_or_stem(F.col("title"), F.col("file_name")).alias("title"),
        F.col("file_name").alias("document_name"),
        "document_type",
        "language",
        F.col("ts").alias("uploaded_at"),
        F.col("ts").alias("updated_at"),
        *[lit(t[c]).alias(c) for c in (
            "status", "processing_status", "priority", "trust_score", "initial_score", "risk_band",
        )],
        lit(t["findings_count"]).cast("bigint").alias("findings_count"),
        F.struct(
            F.col("file_name").alias("name"),
            F.when(F.col("file_size").isNull() | numeric, t["document_size"])
            .otherwise(F.col("file_size")).alias("size"),
            lit(t["page_count"]).alias("page_count"),
            lit(t["raw_text"]).alias("raw_text"),
        ).alias("ai_document"),
    )
    with_ts = files.join(submissions.select("audit_id", "ts"), "audit_id")
    authority = texts.default_authority(F.col("authority"), F.col("ord"))
    sources = with_ts.withColumn("authority", authority).select(
        "audit_id", "ord", "source_id", "name",
        texts.source_type(F.col("name")).alias("type"),
        texts.size_or_default(F.col("size")).alias("size_bytes"),
        F.col("ts").alias("uploaded_at"),
        "authority",
        label_of(F.col("authority"), "authority_file").alias("authority_label"),
        F.to_date("ts").alias("freshness_date"),
        lit(t["source_version"]).alias("version"),
        "hash",
    )
    claim_id = F.concat(lit("CLM-"), "audit_id", lit("-1"))
    flag_id = F.concat(lit("FLG-"), "audit_id", lit("-1"))
    claims = submissions.select(
        "audit_id", claim_id.alias("claim_id"), lit(1).alias("claim_number"),
        lit(t["claim_text"]).alias("text"), lit(t["claim_category"]).alias("category"),
        lit(t["claim_status"]).alias("status"), lit(t["expected_truth"]).alias("expected_truth"),
        lit(t["variance"]).alias("variance"),
    )
    first = files.where("ord = 0").select("audit_id", "source_id", F.col("name").alias("source_name"))
    flags = submissions.join(first, "audit_id", "left").select(
        "audit_id", lit(0).alias("ord"), flag_id.alias("flag_id"), claim_id.alias("claim_id"),
        lit(t["flag_type"]).alias("type"), lit(t["flag_severity"]).alias("severity"),
        lit(t["flag_materiality"]).alias("materiality"), lit(t["claim_text"]).alias("claim"),
        lit(t["flag_reason"]).alias("reason"), lit(t["suggested_fix"]).alias("suggested_fix"),
        lit(t["what_to_check"]).alias("what_to_check"), lit(t["flag_status"]).alias("status"),
        lit(t["flag_impact"]).alias("impact_score"),
        F.struct(
            or_default(F.col("source_id"), t["evidence_source_id"]).alias("source_id"),
            or_default(F.col("source_name"), t["evidence_source_name"]).alias("source_name"),
            lit(t["evidence_authority"]).alias("authority"),
            lit(t["evidence_freshness"]).alias("freshness_date"),
            lit(t["evidence_quote"]).alias("quote"),
            lit(t["evidence_location"]).alias("location"),
        ).alias("evidence"),
    )
    items = submissions.select(
        "audit_id", lit(0).alias("ord"),
        F.concat(lit("WTC-"), "audit_id", lit("-1")).alias("item_id"), lit(1).alias("order"),
        lit(t["check_title"]).alias("title"), lit(t["flag_severity"]).alias("severity"),
        lit(t["flag_materiality"]).alias("materiality"), flag_id.alias("flag_id"),
        lit(t["check_summary"]).alias("summary"), lit(t["check_action"]).alias("action_required"),
    )
    steps = F.array(*[
        F.struct(
            lit(i).alias("ord"), lit(name).alias("name"), lit(deduction).alias("deduction"),
            lit(after).cast("bigint").alias("score_after"), lit(text).alias("description"),
            lit(severity).alias("severity"),
        )
        for i, (name, deduction, after, text, severity) in enumerate(t["waterfall"])
    ])
    waterfall = submissions.select("audit_id", F.explode(steps).alias("s")).select("audit_id", "s.*")
    new = {
        "audits": audits, "source_documents": sources, "claims": claims, "flags": flags,
        "check_items": items, "waterfall": waterfall,
    }
    return {name: with_key(rows) for name, rows in new.items()}

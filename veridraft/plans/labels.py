"""Registered queries: scores, labels and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridraft.functions import scores, texts
from veridraft.plans.registry import query

C = F.col


def band_sql(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 80 THEN 'Trustworthy' WHEN {score} >= 50 THEN 'Review Needed'"
        f" WHEN {score} IS NOT NULL THEN 'High Risk' END"
    )


@query("a16_risk_band", f"SELECT audit_id, trust_score, {band_sql('trust_score')} AS risk_band FROM v_audits", ("v_audits",))
def _(v):
    return v.audits().select("audit_id", "trust_score", scores.risk_band(C("trust_score")).alias("risk_band"))


@query(
    "a17_clamp_score",
    "SELECT audit_id, CASE WHEN reviewed_score IS NULL THEN 0 ELSE CAST(greatest(0, least(100, reviewed_score * 3 - 90)) AS INT) END AS clamped FROM v_audits",
    ("v_audits",),
)
def _(v):
    return v.audits().select("audit_id", scores.clamp_score(C("reviewed_score") * 3 - 90).alias("clamped"))


@query(
    "a18_effective_score",
    f"""SELECT audit_id, score, reviewed_score IS NOT NULL AND status <> 'PROCESSING' AS is_reviewed, {band_sql('score')} AS band
        FROM (SELECT *, CASE WHEN status <> 'PROCESSING' THEN coalesce(reviewed_score, trust_score) END AS score FROM v_audits) x""",
    ("v_audits",),
)
def _(v):
    score = scores.effective_score(C("status"), C("trust_score"), C("reviewed_score"))
    return v.audits().withColumn("score", score).select(
        "audit_id", "score",
        (C("reviewed_score").isNotNull() & (C("status") != "PROCESSING")).alias("is_reviewed"),
        scores.risk_band(C("score")).alias("band"),
    )


RANK_SQL = (
    "CASE {0} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3"
    " WHEN 'INFORMATIONAL' THEN 4 ELSE 99 END"
)


@query(
    "a19_severity_rank",
    f"SELECT o_orderkey, {RANK_SQL.format('upper(split_part(o_orderpriority, chr(45), 2))')} AS severity_rank FROM orders",
)
def _(v):
    word = F.upper(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))
    return v.table("orders").select("o_orderkey", scores.severity_rank(word).alias("severity_rank"))


VERDICT_SQL = (
    "coalesce(verification_status, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'CONTRADICTED'"
    " WHEN severity = 'MEDIUM' THEN 'UNSUPPORTED' ELSE 'UNCERTAIN' END)"
)


@query(
    "a20_infer_verdict",
    f"""SELECT flag_id, {VERDICT_SQL} AS verdict,
       CASE {VERDICT_SQL} WHEN 'CONTRADICTED' THEN 'CONTRADICTED BY GROUND TRUTH' WHEN 'UNSUPPORTED' THEN 'UNSUPPORTED (NO GROUND TRUTH FOUND)'
         WHEN 'UNCERTAIN' THEN 'UNCERTAIN / INCONCLUSIVE EVIDENCE' WHEN 'SUPPORTED' THEN 'SUPPORTED BY AUTHORITATIVE SOURCE'
         ELSE 'REVIEW REQUIRED' END AS verdict_label FROM v_rich""",
    ("v_rich",),
)
def _(v):
    verdict = scores.infer_verdict(C("verification_status"), C("severity"))
    return v.rich_flags().select(
        "flag_id", verdict.alias("verdict"), scores.label_of(verdict, "verdict").alias("verdict_label")
    )


@query(
    "a21_score_state",
    f"""SELECT audit_id, CASE WHEN status = 'PROCESSING' THEN 'calculating' ELSE 'available' END AS state,
        CASE WHEN reviewed_score IS NULL THEN 'calculating' ELSE 'available' END AS reviewed_state,
        CASE WHEN reviewed_score IS NULL THEN 'Score Calculating' ELSE {band_sql('reviewed_score')} END AS reviewed_label
        FROM v_audits""",
    ("v_audits",),
)
def _(v):
    state = scores.resolved_state(F.lit(None).cast("string"), C("reviewed_score"))
    return v.audits().select(
        "audit_id", scores.score_state(C("status")).alias("state"), state.alias("reviewed_state"),
        scores.score_label(state, C("reviewed_score")).alias("reviewed_label"),
    )


@query(
    "a22_flag_labels",
    """SELECT flag_id,
       CASE status WHEN 'ACCEPTED' THEN 'Confirmed Risk' WHEN 'DISMISSED' THEN 'Dismissed' WHEN 'FIXED' THEN 'Remediated'
         ELSE 'Review Required' END AS status_label,
       CASE severity WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'HIGH' THEN 'HIGH' WHEN 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity_label
       FROM v_flags""",
    ("v_flags",),
)
def _(v):
    return v.flags().select(
        "flag_id", scores.label_of(C("status"), "flag_status").alias("status_label"),
        scores.label_of(C("severity"), "severity").alias("severity_label"),
    )


@query(
    "a22_audit_labels",
    """SELECT seq, CASE word WHEN 'VERIFIED' THEN 'VERIFIED' WHEN 'PROCESSING' THEN 'PROCESSING' ELSE 'COMPLETED' END AS status_label,
       CASE state WHEN 'READY' THEN 'Material Conflicts Detected' WHEN 'NO_FINDINGS' THEN '100% Ground Truth Confirmed'
         WHEN 'UNCERTAIN' THEN 'Inconclusive / Reviewer Verification Needed' WHEN 'PARTIAL' THEN 'Partial Ingestion Completed'
         ELSE 'Verification Running' END AS state_label,
       CASE priority WHEN 'CRITICAL' THEN 'MATERIAL RISK' ELSE priority END AS materiality_label
       FROM (SELECT seq, priority, CASE WHEN status = 'REVIEW REQUIRED' THEN 'OTHER' ELSE status END AS word,
             ['READY', 'NO_FINDINGS', 'UNCERTAIN', 'PARTIAL', 'FAILED', 'PROCESSING'][seq % 6 + 1] AS state FROM v_audits) x""",
    ("v_audits",),
)
def _(v):
    return v.audits().selectExpr(
        "seq", "priority", "CASE WHEN status = 'REVIEW REQUIRED' THEN 'OTHER' ELSE status END AS word",
        "element_at(array('READY', 'NO_FINDINGS', 'UNCERTAIN', 'PARTIAL', 'FAILED', 'PROCESSING'), CAST(seq % 6 + 1 AS INT)) AS state",
    ).select(
        "seq", scores.label_of(C("word"), "audit_status").alias("status_label"),
        scores.label_of(C("state"), "result_state").alias("state_label"),
        scores.materiality_label(F.when(C("priority") == "CRITICAL", "MATERIAL").otherwise(C("priority"))).alias("materiality_label"),
    )


@query(
    "a23_audit_progress",
    """SELECT audit_id, status, CASE WHEN status IN ('COMPLETED', 'REVIEW REQUIRED', 'VERIFIED') THEN 100 ELSE 75 END AS percent,
       CASE WHEN status = 'REVIEW REQUIRED' THEN 'Awaiting Human Auditor Sign-off' ELSE 'Analysis complete' END AS stage,
       CASE WHEN status = 'PROCESSING' THEN 'INDEXING' ELSE 'COMPLETED' END AS processing_status FROM v_audits""",
    ("v_audits",),
)
def _(v):
    return v.audits().select(
        "audit_id", "status", scores.progress_percent(C("status")).alias("percent"),
        scores.current_stage(C("status")).alias("stage"),
        scores.or_default(
            F.expr("CASE status WHEN 'PROCESSING' THEN 'INDEXING' WHEN 'VERIFIED' THEN '' END"), "COMPLETED"
        ).alias("processing_status"),
    )


LOCATION_SQL = """CASE loc_type WHEN 'pdf' THEN concat('Page ', loc_n) WHEN 'xlsx' THEN concat('Sheet ', loc_sheet, '!', loc_cell)
    WHEN 'docx' THEN concat('Para ', loc_n, ' (', loc_start, '-', loc_end, ')') WHEN 'text' THEN concat('chars ', loc_start, '..', loc_end) END"""


@query("a24_format_location", f"SELECT flag_id, {LOCATION_SQL} AS location_text FROM v_rich", ("v_rich",))
def _(v):
    return v.rich_flags().select("flag_id", texts.format_location(C("document_location")).alias("location_text"))


@query(
    "a26_format_dates",
    """SELECT audit_id, strftime(uploaded_at, '%d %b, %H:%M') AS short_text, strftime(uploaded_at, '%d %b %Y') AS day_text,
       title AS passed_through FROM v_audits""",
    ("v_audits",),
)
def _(v):
    iso = F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return v.audits().select(
        "audit_id", texts.format_timestamp(iso).alias("short_text"),
        texts.format_timestamp(iso, with_time=False).alias("day_text"),
        texts.format_timestamp(C("title")).alias("passed_through"),
    )


@query(
    "a27_version_view",
    """SELECT seq, CASE WHEN dv <> '' THEN dv ELSE av END AS shown_version, CASE WHEN av <> '' THEN av ELSE 'v3.2' END AS bar_version
       FROM (SELECT seq, CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 3 = 1 THEN concat('d', seq) END AS dv,
             CASE WHEN seq % 2 = 0 THEN concat('a', seq) END AS av FROM v_audits) x""",
    ("v_audits",),
)
def _(v):
    return v.audits().selectExpr(
        "seq", "CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 3 = 1 THEN concat('d', seq) END AS dv",
        "CASE WHEN seq % 2 = 0 THEN concat('a', seq) END AS av",
    ).select(
        "seq", texts.shown_version(C("dv"), C("av")).alias("shown_version"),
        texts.summary_version(C("av")).alias("bar_version"),
    )


@query(
    "a28_rank_text",
    """SELECT item_id, CASE WHEN "order" < 10 THEN concat('0', "order") ELSE CAST("order" AS STRING) END AS rank_text FROM v_check_items""",
    ("v_check_items",),
)
def _(v):
    return v.check_items().select("item_id", texts.rank_text(C("order")).alias("rank_text"))


@query(
    "a29_risk_tiers",
    """SELECT f.flag_id, CASE WHEN materiality = 'Regulatory' THEN 'red' WHEN materiality = 'Operational' THEN 'amber' ELSE 'slate' END AS tier,
       CASE policy1_status WHEN 'VIOLATED' THEN 'red' WHEN 'AT_RISK' THEN 'amber' ELSE 'emerald' END AS policy
       FROM v_rich f WHERE has_policy""",
    ("v_rich",),
)
def _(v):
    return v.rich_flags().where("size(policy_findings) > 0").select(
        "flag_id", scores.materiality_tier(C("materiality_detail.category")).alias("tier"),
        scores.policy_tier(C("policy_findings")[0]["policy_status"]).alias("policy"),
    )


@query(
    "a47_findings_label",
    """SELECT l_orderkey, CASE WHEN n > 0 THEN concat(n, ' findings') ELSE '0' END AS label
       FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY l_orderkey) x""",
)
def _(v):
    counts = v.table("lineitem").groupBy("l_orderkey").agg(F.count_if(C("l_returnflag") != "R").alias("n"))
    return counts.select("l_orderkey", scores.findings_label(C("n")).alias("label"))

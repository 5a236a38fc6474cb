"""Rescoring, result summary, waterfall, progression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridraft import domains as D
from veridraft.functions.columns import audit_key, is_active
from veridraft.functions.scores import clamp_score, risk_band
from veridraft.operators.ordered import GROUP_ROWS, block_chunks, last_before, running_sum, time_chunks
from veridraft.session import materialise


def active_totals(flags: DataFrame) -> DataFrame:
    """Per audit: summed impact and number of active flags (combined before the shuffle)."""
    return flags.where(is_active(F.col("status"))).groupBy("audit_id").agg(
        F.sum("impact_score").alias("active_impact"), F.count(F.lit(1)).alias("active_count")
    )


def rescore(audits: DataFrame, flags: DataFrame) -> DataFrame:
    """A43. Recompute every audit from its flags.

    Starts from a literal 100 and clamps once after the sum. The AI trust score is
    overwritten together with the reviewed score, and the decision counter grows by one,
    as the original does. Audits without active flags score 100 and become VERIFIED.
    """
    return _scored(audits.join(active_totals(flags), "audit_id", "left"), F.lit(1))


def rescore_decided(audits: DataFrame, flags: DataFrame) -> DataFrame:
    """A67. Rescore only audits whose flags were decided on; the decision counter grows by
    the number of decisions, and ``updated_at`` is the time of the last one. ``flags`` has a
    ``decision_count`` (see ``merge_decisions``)."""
    active = is_active(F.col("status"))
    totals = flags.groupBy("audit_id").agg(
        F.sum(F.when(active, F.col("impact_score"))).alias("active_impact"),
        F.count_if(active).alias("active_count"),
        F.sum("decision_count").alias("_decisions"),
        (F.max("decided_at") if "decided_at" in flags.columns else F.lit(None).cast("timestamp")).alias("_decided"),
    ).where("_decisions > 0")
    scored = _scored(audits.join(totals, "audit_id"), F.col("_decisions"))
    if "updated_at" in audits.columns:
        scored = scored.withColumn("updated_at", F.greatest("updated_at", "_decided"))
    return scored.drop("_decisions", "_decided")


def _scored(joined: DataFrame, decisions: Column) -> DataFrame:
    score = clamp_score(F.lit(D.BASELINE_SCORE) + F.coalesce("active_impact", F.lit(0))).cast("int")
    count = F.coalesce("active_count", F.lit(0)).cast("bigint")
    old = F.col("reviewer_decision_count") if "reviewer_decision_count" in joined.columns else F.lit(0)
    return joined.withColumns({
        "trust_score": score,
        "risk_band": risk_band(score),
        "reviewed_score": score,
        "reviewed_risk_band": risk_band(score),
        "reviewer_decision_count": (F.coalesce(old, F.lit(0)) + decisions).cast("bigint"),
        "findings_count": count,
        "status": F.when(count == 0, "VERIFIED").otherwise("REVIEW REQUIRED"),
    }).drop("active_impact", "active_count")


def result_summary(
    audits: DataFrame,
    claims: DataFrame,
    sources: DataFrame,
    flags: DataFrame,
    fallback: int = D.CLAIMS_FALLBACK,
) -> DataFrame:
    """A44. Counts shown above the findings.

    A stored ``result_summary`` wins. Without claims the original shows 4; pass
    ``fallback=0`` for the true count. INFORMATIONAL flags are counted nowhere.
    """
    n = F.count(F.lit(1))
    claim_n = claims.groupBy("audit_id").agg(n.alias("n_claims"))
    source_n = sources.groupBy("audit_id").agg(n.alias("n_sources"))
    severity = F.col("severity")
    flag_n = flags.groupBy("audit_id").agg(
        n.alias("n_flags"),
        *[F.count_if(severity == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
    )
    checked = F.coalesce(F.nullif(F.col("n_claims"), F.lit(0)), F.lit(fallback))
    zero = F.lit(0)
    part = {s: F.coalesce(s, zero) for s in ("critical", "high", "medium", "low")}
    derived = {
        "claims_checked": checked,
        "evidence_matched": F.when(F.col("n_sources") > 0, checked).otherwise(0),
        "contradictions": part["critical"] + part["high"],
        "unsupported_claims": part["medium"],
        "uncertain_claims": part["low"],
        "critical_findings": part["critical"],
        "high_findings": part["high"],
        "medium_findings": part["medium"],
        "low_findings": part["low"],
    }
    state = (
        F.when(F.col("status") == "PROCESSING", "PROCESSING")
        .when(F.coalesce("n_flags", zero) > 0, "FINDINGS_PRESENT")
        .otherwise("NO_FINDINGS")
    )
    stored = "result_summary" in audits.columns

    def pick(name, value):
        if not stored:
            return value
        return F.when(F.col("result_summary").isNotNull(), F.col(f"result_summary.{name}")).otherwise(value)

    return (
        audits.join(claim_n, "audit_id", "left")
        .join(source_n, "audit_id", "left")
        .join(flag_n, "audit_id", "left")
        .select(
            "audit_id",
            *[pick(k, v).cast("bigint").alias(k) for k, v in derived.items()],
            pick("result_state", state).alias("result_state"),
        )
    )


def waterfall(audits: DataFrame, flags: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """B01. Step 0 is the baseline; one step per active flag in array order.

    ``score_after`` is the running, unclamped score. ``final_score`` is filled on the last
    step only and is clamped, so it equals the rescored audit.
    """
    active = flags.where(is_active(F.col("status"))).select(
        "audit_id", "ord", "flag_id", "severity", F.col("impact_score").alias("deduction")
    )
    steps = running_sum(
        active,
        ["audit_id"],
        [F.col("ord")],
        block_chunks("ord"),
        {"_total": F.col("deduction"), "step": F.lit(1)},
        group_rows,
    )
    last = active.groupBy("audit_id").agg(F.count(F.lit(1)).alias("_last"))
    start = audits.select(
        "audit_id", F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("flag_id"),
        F.lit("NEUTRAL").alias("severity"), F.lit(0).alias("deduction"),
        F.lit(0).cast("bigint").alias("_total"), F.lit(0).cast("bigint").alias("step"),
    )
    after = F.lit(D.BASELINE_SCORE) + F.col("_total")
    return (
        start.unionByName(steps)
        .join(last, "audit_id", "left")
        .select(
            "audit_id",
            "step",
            "flag_id",
            "severity",
            "deduction",
            after.alias("score_after"),
            F.when(F.col("step") == F.coalesce("_last", F.lit(0)), clamp_score(after))
            .cast("int").alias("final_score"),
        )
    )


def score_progression(flags: DataFrame, decisions: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """B02. Score and unresolved flags of an audit after every accepted decision.

    A decision changes the score by *new contribution - previous contribution* of its flag;
    running sums per audit then give the score. Unknown actions are steps without change.
    Decisions on unknown flags are ignored here (see ``decisions.split_decisions``).
    The changes are written once, because the running sums read them twice.
    """
    known = flags.select(
        audit_key(F.col("audit_id")).alias("_k"), "flag_id", "impact_score",
        is_active(F.col("status")).cast("int").alias("_active0"),
    )
    log = (
        decisions.withColumn("_k", audit_key(F.col("audit_id"))).drop("audit_id")
        .join(known, ["_k", "flag_id"])
        .select(
            "_k", "flag_id", "decision_id", "ts", "action", "impact_score", "_active0",
            F.when(F.col("action").isin(*D.ACTION_STATUS), (F.col("action") == "ACCEPT").cast("int"))
            .alias("_active"),
        )
    )
    order = ["ts", "decision_id"]
    changes = last_before(
        log, ["_k", "flag_id"], order, time_chunks(), "_active", "_before", group_rows
    ).select(
        "_k", "flag_id", "decision_id", "ts", "action", "impact_score",
        F.coalesce(F.col("_active") - F.coalesce("_before", "_active0"), F.lit(0)).alias("_step"),
    )
    moved = running_sum(
        materialise(changes, "score-changes"),
        ["_k"],
        [F.col(c) for c in order],
        time_chunks(),
        {
            "_impact": F.col("_step") * F.col("impact_score"),
            "_count": F.col("_step"),
            "step": F.lit(1),
        },
        group_rows,
    )
    start = flags.groupBy(audit_key(F.col("audit_id")).alias("_k")).agg(
        F.min("audit_id").alias("audit_id"),
        F.sum(F.when(is_active(F.col("status")), F.col("impact_score")).otherwise(0)).alias("_impact0"),
        F.count_if(is_active(F.col("status"))).alias("_count0"),
    )
    return moved.join(start, "_k").select(
        "audit_id",
        "step",
        "decision_id",
        "ts",
        "flag_id",
        "action",
        clamp_score(F.lit(D.BASELINE_SCORE) + F.col("_impact0") + F.col("_impact")).cast("int").alias("score"),
        (F.col("_count0") + F.col("_count")).alias("unresolved_flags"),
    )


def score_peak(progression: DataFrame) -> DataFrame:
    """B02. Highest and latest score per audit."""
    return progression.groupBy("audit_id").agg(
        F.max("score").alias("peak_score"),
        F.max_by("score", "step").alias("final_score"),
        F.count(F.lit(1)).alias("decisions"),
    )

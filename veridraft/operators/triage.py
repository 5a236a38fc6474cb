"""Review queue, filters, selection, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridraft import domains as D
from veridraft.functions.columns import is_active
from veridraft.functions.scores import severity_rank
from veridraft.operators.ordered import position

SEVERITIES = list(D.SEVERITY_RANK)


def search_audits(audits: DataFrame, query: str) -> DataFrame:
    """A30. Case-insensitive literal substring of id, title or document name."""
    needle = F.lit(query.lower())
    hit = F.lit(False)
    for column in ("audit_id", "title", "document_name"):
        hit = hit | F.contains(F.lower(F.col(column)), needle)
    return audits if query == "" else audits.where(hit)


def filter_risk(audits: DataFrame, risk: str) -> DataFrame:
    """A31."""
    return audits if risk == "ALL" else audits.where(F.col("priority") == risk)


def filter_status(audits: DataFrame, status: str) -> DataFrame:
    """A32."""
    return audits if status == "ALL" else audits.where(F.col("status") == status)


def finding_visible(finding: str, strict_uncertain: bool = False) -> Column:
    """A33. Predicate on (status, severity).

    UNCERTAIN keeps every pending flag whatever its severity, as the workspace does;
    ``strict_uncertain`` narrows it to LOW severity only.
    """
    if finding == "ALL":
        return F.lit(True)
    if finding == "UNCERTAIN":
        low = F.col("severity") == "LOW"
        return low if strict_uncertain else (F.col("status") == "PENDING") | low
    return F.col("severity") == finding


def filter_findings(flags: DataFrame, finding: str, strict_uncertain: bool = False) -> DataFrame:
    """A33."""
    return flags.where(finding_visible(finding, strict_uncertain))


def active_flags(flags: DataFrame) -> DataFrame:
    """A34."""
    return flags.where(is_active(F.col("status")))


def pick_flag(flags: DataFrame, selection: DataFrame | None = None, finding: str = "ALL") -> DataFrame:
    """A35. Per audit: the selected flag, else the first filtered one, else the first.

    selection(audit_id, flag_id). One aggregation, combined before the shuffle.
    """
    if selection is not None:
        chosen = selection.select("audit_id", "flag_id", F.lit(True).alias("_chosen"))
        flags = flags.join(chosen, ["audit_id", "flag_id"], "left")
    else:
        flags = flags.withColumn("_chosen", F.lit(None).cast("boolean"))
    rank = F.struct(
        F.when(F.col("_chosen"), 0).when(finding_visible(finding), 1).otherwise(2).alias("tier"),
        F.col("ord"),
    )
    return flags.groupBy("audit_id").agg(
        F.min(F.struct(rank.alias("r"), F.col("flag_id"))).alias("best")
    ).select("audit_id", "best.flag_id", F.col("best.r.tier").alias("tier"))


def has_context(flags: DataFrame, with_omissions: bool = False) -> DataFrame:
    """A36. Adds ``has_context``."""
    context = F.col("materiality_detail").isNotNull() | (
        F.coalesce(F.size("policy_findings"), F.lit(0)) > 0
    )
    if with_omissions:
        context = context | (F.coalesce(F.size("omission_findings"), F.lit(0)) > 0)
    return flags.withColumn("has_context", context)


def review_queue(audits: DataFrame, query: str = "", risk: str = "ALL", status: str = "ALL") -> DataFrame:
    """A37. Filtered queue with its 1-based ``position`` (worst first, newest first).

    Positions are chained over blocks of ``seq``, so no task sees the whole list.
    """
    found = filter_status(filter_risk(search_audits(audits, query), risk), status)
    ranked = found.withColumn("severity_rank", severity_rank(F.col("priority")))
    return position(
        ranked,
        [],
        [F.col("severity_rank"), F.desc("seq")],
        [F.col("severity_rank"), -F.floor(F.col("seq") / (1 << 32)), -F.floor(F.col("seq") / (1 << 16))],
        "position",
    )


def recent_audits(audits: DataFrame, n: int = 4) -> DataFrame:
    """A38. First n of the list; the list is newest first, not sorted by risk."""
    return audits.orderBy(F.desc("seq")).limit(n)


def headline_audit(audits: DataFrame) -> DataFrame:
    """A39. First CRITICAL or HIGH audit in list order, else the first audit."""
    urgent = F.coalesce(F.col("priority").isin("CRITICAL", "HIGH"), F.lit(False))
    return audits.orderBy(F.desc(urgent), F.desc("seq")).limit(1)


def checklist(items: DataFrame, selection: DataFrame) -> DataFrame:
    """A40. Items, marked where they point at the audit's selected flag.

    selection(audit_id, flag_id): one row per audit. Items lie in array order (``ord``) within
    a partition; a total order over all audits would serve nobody.
    """
    chosen = selection.select("audit_id", F.col("flag_id").alias("_selected"))
    return (
        items.join(chosen, "audit_id", "left")
        .withColumn("is_selected", F.coalesce(F.col("flag_id") == F.col("_selected"), F.lit(False)))
        .drop("_selected")
        .sortWithinPartitions("audit_id", "ord")
    )


def dashboard(audits: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """A41. All figures in one aggregation; optionally per group."""
    return audits.groupBy(*(group_by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "PROCESSING").alias("processing"),
        F.count_if(F.col("status") == "REVIEW REQUIRED").alias("awaiting_review"),
        F.count_if(F.col("priority") == "CRITICAL").alias("critical"),
        F.count_if(F.col("status") == "VERIFIED").alias("verified"),
        F.round(F.avg(F.when(F.col("status") != "PROCESSING", F.col("trust_score"))))
        .cast("int").alias("avg_ai_score"),
        F.round(F.avg("reviewed_score")).cast("int").alias("avg_reviewed_score"),
    )


def queue_kpis(audits: DataFrame) -> DataFrame:
    """A42. Over the unfiltered list."""
    return audits.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("priority") == "CRITICAL").alias("critical"),
        F.count_if(F.col("status") == "REVIEW REQUIRED").alias("review_required"),
        F.count_if(F.col("status") == "VERIFIED").alias("verified"),
        F.count_if(F.col("status") == "PROCESSING").alias("processing"),
    )


def severity_facets(flags: DataFrame) -> DataFrame:
    """A45. Flags per severity and audit, one column per severity."""
    return flags.groupBy("audit_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES]
    )


def policy_counts(flags: DataFrame) -> DataFrame:
    """A46. Policy findings per flag."""
    return flags.select(
        "audit_id", "flag_id",
        F.coalesce(F.size("policy_findings"), F.lit(0)).alias("policy_count"),
    )


def policy_rows(flags: DataFrame) -> DataFrame:
    """A46. One row per policy finding (flags without any keep one empty row)."""
    return flags.select(
        "audit_id", "flag_id", F.posexplode_outer("policy_findings").alias("policy_ord", "p")
    ).select("audit_id", "flag_id", "policy_ord", "p.policy_name", "p.rationale", "p.policy_status")


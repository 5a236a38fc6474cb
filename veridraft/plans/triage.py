"""Registered queries: filters, queue, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridraft.operators import triage as T
from veridraft.plans.labels import RANK_SQL
from veridraft.plans.registry import query

C = F.col
HIT = "contains(lower(audit_id), '{0}') OR contains(lower(title), '{0}') OR contains(lower(document_name), '{0}')"


@query(
    "a30_search_audits",
    f"SELECT audit_id, title, document_name FROM v_audits WHERE {HIT.format('furni')}",
    ("v_audits",),
)
def _(v):
    return T.search_audits(v.audits(), "Furni").select("audit_id", "title", "document_name")


@query(
    "a30_search_literal",
    f"""SELECT audit_id FROM (SELECT audit_id, replace(title, 'BUILDING', '100%_BUILT') AS title, document_name FROM v_audits) x
        WHERE {HIT.format('%_b')}""",
    ("v_audits",),
)
def _(v):
    # titles with characters that are wild cards elsewhere
    audits = v.audits().withColumn("title", F.replace("title", F.lit("BUILDING"), F.lit("100%_BUILT")))
    return T.search_audits(audits, "%_B").select("audit_id")


@query("a31_filter_risk", "SELECT audit_id, priority FROM v_audits WHERE priority = 'HIGH'", ("v_audits",))
def _(v):
    return T.filter_risk(v.audits(), "HIGH").select("audit_id", "priority")


@query("a32_filter_status", "SELECT audit_id, status FROM v_audits WHERE status = 'VERIFIED'", ("v_audits",))
def _(v):
    return T.filter_status(v.audits(), "VERIFIED").select("audit_id", "status")


@query(
    "a33_filter_findings",
    "SELECT flag_id, severity, status FROM v_flags WHERE status = 'PENDING' OR severity = 'LOW'",
    ("v_flags",),
)
def _(v):
    return T.filter_findings(v.flags(), "UNCERTAIN").select("flag_id", "severity", "status")


@query("a33_filter_severity", "SELECT flag_id, severity FROM v_flags WHERE severity = 'HIGH'", ("v_flags",))
def _(v):
    return T.filter_findings(v.flags(), "HIGH").select("flag_id", "severity")


@query("a34_active_flags", "SELECT audit_id, flag_id FROM v_flags WHERE status IN ('PENDING', 'ACCEPTED')", ("v_flags",))
def _(v):
    return T.active_flags(v.flags()).select("audit_id", "flag_id")


def selection(v):
    """One selected flag per audit: the one with the strongest impact, if it is strong."""
    return (
        v.flags().groupBy("audit_id")
        .agg(F.min(F.struct("impact_score", "flag_id")).alias("s"))
        .where("s.impact_score <= -12")
        .select("audit_id", "s.flag_id")
    )


SELECTION_SQL = """v_selection AS (SELECT audit_id, flag_id FROM (
  SELECT audit_id, flag_id, impact_score, row_number() OVER (PARTITION BY audit_id ORDER BY impact_score, flag_id) AS r FROM v_flags) q
  WHERE r = 1 AND impact_score <= -12)"""


@query(
    "a35_pick_flag",
    f"""WITH {SELECTION_SQL}
       SELECT audit_id, flag_id, tier FROM (
         SELECT f.audit_id, f.flag_id, CASE WHEN s.flag_id IS NOT NULL THEN 0 WHEN f.severity = 'HIGH' THEN 1 ELSE 2 END AS tier,
           row_number() OVER (PARTITION BY f.audit_id ORDER BY CASE WHEN s.flag_id IS NOT NULL THEN 0 WHEN f.severity = 'HIGH' THEN 1 ELSE 2 END, f.ord) AS r
         FROM v_flags f LEFT JOIN v_selection s ON f.audit_id = s.audit_id AND f.flag_id = s.flag_id) x WHERE r = 1""",
    ("v_flags",),
)
def _(v):
    return T.pick_flag(v.flags(with_ord=True), selection(v), "HIGH")


@query(
    "a36_has_context",
    """SELECT flag_id, materiality IS NOT NULL OR has_policy AS has_context,
       materiality IS NOT NULL OR has_policy OR has_omission AS has_panel_context FROM v_rich""",
    ("v_rich",),
)
def _(v):
    panel = T.has_context(v.rich_flags(), with_omissions=True).withColumnRenamed("has_context", "has_panel_context")
    return T.has_context(panel).select("flag_id", "has_context", "has_panel_context")


@query(
    "a37_review_queue",
    f"""SELECT audit_id, priority, status, position FROM (
          SELECT *, row_number() OVER (ORDER BY {RANK_SQL.format('priority')}, seq DESC) AS position
          FROM v_audits WHERE status = 'REVIEW REQUIRED' AND ({HIT.format('customer')})) x""",
    ("v_audits",),
)
def _(v):
    return T.review_queue(v.audits(), query="Customer", status="REVIEW REQUIRED").select(
        "audit_id", "priority", "status", "position"
    )


@query(
    "a37_review_queue_all",
    f"""SELECT audit_id, row_number() OVER (ORDER BY {RANK_SQL.format('priority')}, seq DESC) AS position FROM v_audits""",
    ("v_audits",),
)
def _(v):
    return T.review_queue(v.audits()).select("audit_id", "position")


@query("a38_recent_audits", "SELECT seq, audit_id, title FROM v_audits ORDER BY seq DESC LIMIT 4", ("v_audits",))
def _(v):
    return T.recent_audits(v.audits()).select("seq", "audit_id", "title")


@query(
    "a39_headline_audit",
    """SELECT seq, audit_id, priority FROM v_audits
       ORDER BY CASE WHEN priority IN ('CRITICAL', 'HIGH') THEN 0 ELSE 1 END, seq DESC LIMIT 1""",
    ("v_audits",),
)
def _(v):
    return T.headline_audit(v.audits()).select("seq", "audit_id", "priority")


@query(
    "a40_checklist",
    f"""WITH {SELECTION_SQL}
       SELECT i.audit_id, i.item_id, coalesce(i.flag_id = s.flag_id, FALSE) AS is_selected
       FROM v_check_items i LEFT JOIN v_selection s ON i.audit_id = s.audit_id""",
    ("v_flags", "v_check_items"),
)
def _(v):
    items = v.check_items().withColumn("ord", C("order"))
    return T.checklist(items, selection(v)).select("audit_id", "item_id", "is_selected")


DASHBOARD_SQL = """count(*) AS total, count(*) FILTER (status = 'PROCESSING') AS processing,
    count(*) FILTER (status = 'REVIEW REQUIRED') AS awaiting_review, count(*) FILTER (priority = 'CRITICAL') AS critical,
    count(*) FILTER (status = 'VERIFIED') AS verified,
    CAST(round(avg(trust_score) FILTER (status <> 'PROCESSING')) AS INT) AS avg_ai_score,
    CAST(round(avg(reviewed_score)) AS INT) AS avg_reviewed_score"""


@query("a41_dashboard", f"SELECT {DASHBOARD_SQL} FROM v_audits", ("v_audits",))
def _(v):
    return T.dashboard(v.audits())


@query(
    "a41_dashboard_by_priority",
    f"SELECT priority, {DASHBOARD_SQL} FROM v_audits GROUP BY priority",
    ("v_audits",),
)
def _(v):
    return T.dashboard(v.audits(), ["priority"])


@query(
    "a42_queue_kpis",
    """SELECT count(*) AS total, count(*) FILTER (priority = 'CRITICAL') AS critical,
       count(*) FILTER (status = 'REVIEW REQUIRED') AS review_required, count(*) FILTER (status = 'VERIFIED') AS verified,
       count(*) FILTER (status = 'PROCESSING') AS processing FROM v_audits""",
    ("v_audits",),
)
def _(v):
    return T.queue_kpis(v.audits())


@query(
    "a45_severity_facets",
    "SELECT audit_id, "
    + ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s.lower()}" for s in T.SEVERITIES)
    + " FROM v_flags GROUP BY audit_id",
    ("v_flags",),
)
def _(v):
    return T.severity_facets(v.flags())


@query(
    "a46_policy_counts",
    """SELECT audit_id, flag_id, CAST(has_policy AS INT) + CAST(has_policy2 AS INT) AS policy_count FROM v_rich""",
    ("v_rich",),
)
def _(v):
    return T.policy_counts(v.rich_flags())


@query(
    "a46_policy_rows",
    """SELECT audit_id, flag_id, policy_ord, policy_name, rationale, policy_status FROM v_policy_rows
       UNION ALL SELECT audit_id, flag_id, NULL, NULL, NULL, NULL FROM v_rich WHERE NOT has_policy""",
    ("v_rich", "v_policy_rows"),
)
def _(v):
    return T.policy_rows(v.rich_flags())

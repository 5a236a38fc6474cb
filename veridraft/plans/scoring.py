"""Registered queries: rescoring, summary, waterfall, progression."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veridraft.operators import scoring as S
from veridraft.operators import triage as T
from veridraft.plans.labels import RANK_SQL, band_sql
from veridraft.plans.registry import query

RESCORED = """SELECT a.audit_id, a.seq, a.priority,
      CAST(greatest(0, least(100, 100 + coalesce(sum(f.impact_score) FILTER (f.status IN ('PENDING', 'ACCEPTED')), 0))) AS INT) AS score,
      count(*) FILTER (f.status IN ('PENDING', 'ACCEPTED')) AS findings_count
    FROM v_audits a LEFT JOIN v_flags f ON a.audit_id = f.audit_id GROUP BY a.audit_id, a.seq, a.priority"""


@query(
    "a43_rescore",
    f"""SELECT audit_id, score AS trust_score, {band_sql('score')} AS risk_band, score AS reviewed_score,
        {band_sql('score')} AS reviewed_risk_band, CAST(1 AS BIGINT) AS reviewer_decision_count, findings_count,
        CASE WHEN findings_count = 0 THEN 'VERIFIED' ELSE 'REVIEW REQUIRED' END AS status FROM ({RESCORED}) x""",
    ("v_audits", "v_flags"),
)
def _(v):
    return S.rescore(v.audits(), v.flags()).select(
        "audit_id", "trust_score", "risk_band", "reviewed_score", "reviewed_risk_band",
        "reviewer_decision_count", "findings_count", "status",
    )


def rescored_queue(v) -> DataFrame:
    """Flagship: rescore every audit from its flags and rank the review queue."""
    return T.review_queue(S.rescore(v.audits(), v.flags())).select(
        "position", "audit_id", "priority", "trust_score", "risk_band", "findings_count", "status"
    )


query(
    "a43_rescored_queue",
    f"""SELECT row_number() OVER (ORDER BY {RANK_SQL.format('priority')}, seq DESC) AS position, audit_id, priority,
        score AS trust_score, {band_sql('score')} AS risk_band, findings_count,
        CASE WHEN findings_count = 0 THEN 'VERIFIED' ELSE 'REVIEW REQUIRED' END AS status FROM ({RESCORED}) x""",
    ("v_audits", "v_flags"),
)(rescored_queue)


@query(
    "a44_result_summary",
    """SELECT a.audit_id, CAST(coalesce(c.n, 4) AS BIGINT) AS claims_checked,
       CAST(CASE WHEN s.n > 0 THEN coalesce(c.n, 4) ELSE 0 END AS BIGINT) AS evidence_matched,
       CAST(coalesce(f.crit + f.high, 0) AS BIGINT) AS contradictions, CAST(coalesce(f.med, 0) AS BIGINT) AS unsupported_claims,
       CAST(coalesce(f.low, 0) AS BIGINT) AS uncertain_claims, CAST(coalesce(f.crit, 0) AS BIGINT) AS critical_findings,
       CAST(coalesce(f.high, 0) AS BIGINT) AS high_findings, CAST(coalesce(f.med, 0) AS BIGINT) AS medium_findings,
       CAST(coalesce(f.low, 0) AS BIGINT) AS low_findings,
       CASE WHEN a.status = 'PROCESSING' THEN 'PROCESSING' WHEN f.n > 0 THEN 'FINDINGS_PRESENT' ELSE 'NO_FINDINGS' END AS result_state
       FROM v_audits a
       LEFT JOIN (SELECT audit_id, count(*) AS n FROM v_claims GROUP BY audit_id) c ON a.audit_id = c.audit_id
       LEFT JOIN (SELECT audit_id, count(*) AS n FROM v_audit_sources GROUP BY audit_id) s ON a.audit_id = s.audit_id
       LEFT JOIN (SELECT audit_id, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS crit, count(*) FILTER (severity = 'HIGH') AS high,
                  count(*) FILTER (severity = 'MEDIUM') AS med, count(*) FILTER (severity = 'LOW') AS low FROM v_flags GROUP BY audit_id) f
         ON a.audit_id = f.audit_id""",
    ("v_audits", "v_claims", "v_audit_sources", "v_flags"),
)
def _(v):
    return S.result_summary(v.audits(), v.claims(), v.audit_sources(), v.flags())


WATERFALL_SQL = """WITH act AS (SELECT *, row_number() OVER w AS step, count(*) OVER (PARTITION BY audit_id) AS n,
         100 + sum(impact_score) OVER w AS after FROM v_flags WHERE status IN ('PENDING', 'ACCEPTED')
         WINDOW w AS (PARTITION BY audit_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
       SELECT audit_id, step, flag_id, severity, impact_score AS deduction, CAST(after AS BIGINT) AS score_after,
         CAST(CASE WHEN step = n THEN greatest(0, least(100, after)) END AS INT) AS final_score FROM act
       UNION ALL
       SELECT audit_id, 0, NULL, 'NEUTRAL', 0, 100, CASE WHEN audit_id NOT IN (SELECT audit_id FROM act) THEN 100 END FROM v_audits"""


@query("b01_waterfall", WATERFALL_SQL, ("v_audits", "v_flags"))
def _(v):
    return S.waterfall(v.audits(), v.flags(with_ord=True))


@query("b01_waterfall_large_audits", WATERFALL_SQL, ("v_audits", "v_flags"))
def _(v):
    # audits with more than three active flags are treated as too large for one task
    return S.waterfall(v.audits(), v.flags(with_ord=True, group_rows=3), group_rows=3)


PROGRESS = """kn AS (SELECT d.*, f.impact_score, CASE WHEN d.action = 'ACCEPT' THEN 1 ELSE 0 END AS act
         FROM v_decisions d JOIN v_decision_flags f ON d.audit_id = f.audit_id AND d.flag_id = f.flag_id),
       ch AS (SELECT *, act - lag(act, 1, 1) OVER (PARTITION BY audit_id, flag_id ORDER BY ts, decision_id) AS delta
         FROM kn WHERE action IN ('ACCEPT', 'DISMISS', 'FIX')
         UNION ALL SELECT *, 0 AS delta FROM kn WHERE action NOT IN ('ACCEPT', 'DISMISS', 'FIX')),
       st AS (SELECT audit_id, sum(impact_score) AS impact0, count(*) AS n0 FROM v_decision_flags GROUP BY audit_id),
       run AS (SELECT audit_id, decision_id, flag_id, action, row_number() OVER w AS step, sum(delta * impact_score) OVER w AS impact, sum(delta) OVER w AS n
         FROM ch WINDOW w AS (PARTITION BY audit_id ORDER BY ts, decision_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
       prog AS (SELECT r.audit_id, r.step, r.decision_id, r.flag_id, r.action,
         CAST(greatest(0, least(100, 100 + s.impact0 + r.impact)) AS INT) AS score, CAST(s.n0 + r.n AS BIGINT) AS unresolved_flags
         FROM run r JOIN st s ON r.audit_id = s.audit_id)"""


@query("b02_score_progression", f"WITH {PROGRESS} SELECT * FROM prog", ("v_decisions", "v_decision_flags"))
def _(v):
    return S.score_progression(v.decision_flags(), v.decisions()).drop("ts")


@query("b02_progression_large_audits", f"WITH {PROGRESS} SELECT * FROM prog", ("v_decisions", "v_decision_flags"))
def _(v):
    # all audits and most flags are treated as too large for one task
    return S.score_progression(v.decision_flags(), v.decisions(), group_rows=50).drop("ts")


@query(
    "b02_score_peak",
    f"""WITH {PROGRESS} SELECT audit_id, max(score) AS peak_score, arg_max(score, step) AS final_score, count(*) AS decisions
        FROM prog GROUP BY audit_id""",
    ("v_decisions", "v_decision_flags"),
)
def _(v):
    return S.score_peak(S.score_progression(v.decision_flags(), v.decisions()))

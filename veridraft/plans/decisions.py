"""Registered queries: reviewer decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridraft.functions import scores
from veridraft.operators import decisions as R
from veridraft.plans.labels import band_sql
from veridraft.plans.registry import query

C = F.col
BOTH = ("v_decisions", "v_decision_flags")
CURRENT = """cur AS (SELECT f.audit_id, f.flag_id, f.impact_score, coalesce(s.st, 'PENDING') AS status, n.note AS reviewer_note, coalesce(k.n, 0) AS decision_count
   FROM v_decision_flags f
   LEFT JOIN (SELECT audit_id, flag_id, st FROM (SELECT audit_id, flag_id, CASE action WHEN 'ACCEPT' THEN 'ACCEPTED' WHEN 'DISMISS' THEN 'DISMISSED' ELSE 'FIXED' END AS st,
        row_number() OVER (PARTITION BY audit_id, flag_id ORDER BY ts DESC, decision_id DESC) AS r FROM v_decisions WHERE action IN ('ACCEPT', 'DISMISS', 'FIX')) a WHERE r = 1) s
     ON f.audit_id = s.audit_id AND f.flag_id = s.flag_id
   LEFT JOIN (SELECT audit_id, flag_id, note FROM (SELECT audit_id, flag_id,
        CASE WHEN action = 'FIX' AND coalesce(note, '') = '' THEN 'Applied suggested fix' ELSE note END AS note,
        row_number() OVER (PARTITION BY audit_id, flag_id ORDER BY ts DESC, decision_id DESC) AS r FROM v_decisions WHERE action IN ('DISMISS', 'FIX')) b WHERE r = 1) n
     ON f.audit_id = n.audit_id AND f.flag_id = n.flag_id
   LEFT JOIN (SELECT audit_id, flag_id, count(*) AS n FROM v_decisions GROUP BY audit_id, flag_id) k
     ON f.audit_id = k.audit_id AND f.flag_id = k.flag_id)"""
SCORED = f"""{CURRENT}, sc AS (SELECT audit_id,
      CAST(greatest(0, least(100, 100 + coalesce(sum(impact_score) FILTER (status IN ('PENDING', 'ACCEPTED')), 0))) AS INT) AS score,
      count(*) FILTER (status IN ('PENDING', 'ACCEPTED')) AS findings_count, CAST(sum(decision_count) AS BIGINT) AS reviewer_decision_count
      FROM cur GROUP BY audit_id)"""
PROCESSED_SQL = f"""WITH {SCORED} SELECT audit_id, score AS trust_score, {band_sql('score')} AS risk_band, findings_count,
      CASE WHEN findings_count = 0 THEN 'VERIFIED' ELSE 'REVIEW REQUIRED' END AS status, reviewer_decision_count
      FROM sc WHERE reviewer_decision_count > 0"""
PROCESSED_COLUMNS = ["audit_id", "trust_score", "risk_band", "findings_count", "status", "reviewer_decision_count"]


@query(
    "a50_join_flags",
    """SELECT d.decision_id, d.audit_id, d.flag_id, d.action, f.impact_score
       FROM v_decisions d JOIN v_decision_flags f ON lower(d.audit_id) = lower(f.audit_id) AND d.flag_id = f.flag_id""",
    BOTH,
)
def _(v):
    # the log spells audit ids in lower case here
    log = v.decisions().withColumn("audit_id", F.lower("audit_id"))
    return R.join_flags(log, v.decision_flags()).select(
        "decision_id", F.upper("audit_id").alias("audit_id"), "flag_id", "action", "impact_score"
    )


@query(
    "a63_apply_decisions",
    f"WITH {CURRENT} SELECT audit_id, flag_id, impact_score, status, reviewer_note, decision_count FROM cur",
    BOTH,
)
def _(v):
    return R.apply_decisions(v.decision_flags(), v.decisions()).select(
        "audit_id", "flag_id", "impact_score", "status", "reviewer_note", "decision_count"
    )


HISTORY = ["audit_id", "flag_id", "decision_id", "action", "note", "reviewed_by", "step"]
HISTORY_SQL = """SELECT audit_id, flag_id, decision_id, action, note, reviewed_by,
       row_number() OVER (PARTITION BY audit_id, flag_id ORDER BY ts, decision_id) AS step FROM v_decisions"""


@query("a64_decision_history", HISTORY_SQL, ("v_decisions",))
def _(v):
    return R.decision_history(v.decisions()).select(*HISTORY)


@query("a64_history_large_flags", HISTORY_SQL, ("v_decisions",))
def _(v):
    # every flag with more than 50 decisions is treated as too large for one task
    return R.decision_history(v.decisions(), group_rows=50).select(*HISTORY)


def _log_with_unknown_audits(v):
    return v.decisions().withColumn(
        "audit_id", F.when(C("action") == "error", F.lit("AUD-none")).otherwise(C("audit_id"))
    )


REJECT_SQL = """FROM (SELECT decision_id, flag_id, action, CASE WHEN action = 'error' THEN 'AUD-none' ELSE audit_id END AS audit_id FROM v_decisions) d
   LEFT JOIN (SELECT DISTINCT audit_id FROM v_decisions) a ON d.audit_id = a.audit_id
   LEFT JOIN v_decision_flags f ON d.audit_id = f.audit_id AND d.flag_id = f.flag_id"""


@query(
    "a65_rejected_decisions",
    f"""SELECT d.decision_id, d.audit_id, d.flag_id, CASE WHEN a.audit_id IS NULL THEN 'Audit not found' ELSE 'Flag not found' END AS reason
        {REJECT_SQL} WHERE a.audit_id IS NULL OR f.flag_id IS NULL""",
    BOTH,
)
def _(v):
    _ok, rejected = R.split_decisions(_log_with_unknown_audits(v), v.decision_audits(), v.decision_flags())
    return rejected.select("decision_id", "audit_id", "flag_id", "reason")


@query(
    "a65_accepted_decisions",
    f"SELECT d.decision_id, d.audit_id, d.flag_id {REJECT_SQL} WHERE a.audit_id IS NOT NULL AND f.flag_id IS NOT NULL",
    BOTH,
)
def _(v):
    ok, _rejected = R.split_decisions(_log_with_unknown_audits(v), v.decision_audits(), v.decision_flags())
    return ok.select("decision_id", "audit_id", "flag_id")


@query(
    "a66_invalid_notes",
    """SELECT decision_id, action, note FROM v_decisions
       WHERE (action = 'DISMISS' OR (action = 'FIX' AND decision_id % 2 = 0)) AND trim(coalesce(note, '')) = ''""",
    ("v_decisions",),
)
def _(v):
    log = v.decisions().withColumn("is_edit", C("decision_id") % 2 == 0)
    _ok, invalid = R.validate_notes(log)
    return invalid.select("decision_id", "action", "note")


@query("a67_process_decisions", PROCESSED_SQL, BOTH)
def _(v):
    done = R.process_decisions(v.decision_audits(), v.decision_flags(), v.decisions())
    return done["audits"].select(*PROCESSED_COLUMNS)


@query(
    "a67_processed_flags",
    """WITH a AS (SELECT DISTINCT audit_id FROM v_decision_flags WHERE audit_id <> 'AUD-3'),
         d AS (SELECT x.* FROM (SELECT DISTINCT ON (decision_id) * FROM (
             SELECT * FROM v_decisions UNION ALL SELECT * REPLACE (ts + INTERVAL 400 DAY AS ts) FROM v_decisions WHERE decision_id % 3 = 0) b
           ORDER BY decision_id, ts) x JOIN a ON x.audit_id = a.audit_id),
         m AS (SELECT audit_id, flag_id, arg_max(CASE action WHEN 'ACCEPT' THEN 'ACCEPTED' WHEN 'DISMISS' THEN 'DISMISSED' ELSE 'FIXED' END,
             struct_pack(ts := ts, id := decision_id)) FILTER (action IN ('ACCEPT', 'DISMISS', 'FIX')) AS st, count(*) AS n FROM d GROUP BY audit_id, flag_id)
       SELECT f.audit_id, f.flag_id, coalesce(m.st, 'PENDING') AS status, coalesce(m.n, 0) AS decision_count
       FROM v_decision_flags f LEFT JOIN m ON f.audit_id = m.audit_id AND f.flag_id = m.flag_id""",
    BOTH,
)
def _(v):
    # one audit is unknown though its flags are there, and a third of the log was delivered again later
    again = v.decisions().where("decision_id % 3 = 0").withColumn("ts", F.expr("ts + INTERVAL 400 DAYS"))
    audits = v.decision_audits().where("audit_id <> 'AUD-3'")
    done = R.process_decisions(audits, v.decision_flags(), v.decisions().unionByName(again))
    return done["flags"].select("audit_id", "flag_id", "status", "decision_count")


@query(
    "a68_decision_feedback",
    """SELECT decision_id, CASE action WHEN 'ACCEPT' THEN 'Finding accepted. Risk confirmed on audit record.'
       WHEN 'FIX' THEN 'Marked as fixed. Trust score recalibrated.' ELSE 'Finding dismissed with documented rationale.' END AS feedback
       FROM v_decisions""",
    ("v_decisions",),
)
def _(v):
    return v.decisions().select("decision_id", scores.decision_feedback(C("action")).alias("feedback"))


@query(
    "a69_candidate_edits",
    """SELECT doc_id, flag_id, CASE WHEN severity = 'LOW' THEN claim WHEN severity = 'HIGH' THEN 'Use the approved wording.' ELSE claim END AS candidate
       FROM v_doc_flags""",
    ("v_doc_flags",),
)
def _(v):
    fixes = F.when(C("severity") == "LOW", "").when(C("severity") == "HIGH", "Use the approved wording.")
    flags = v.doc_flags().withColumn("suggested_fix", fixes).withColumn("audit_id", C("doc_id"))
    return R.candidate_edits(flags).withColumnRenamed("audit_id", "doc_id")


@query(
    "a69_edits_applied",
    """SELECT f.audit_id, f.flag_id, CASE WHEN e.note IS NOT NULL THEN 'FIXED' ELSE 'PENDING' END AS status, e.note AS reviewer_note
       FROM v_decision_flags f LEFT JOIN (SELECT audit_id, flag_id, arg_max(note, struct_pack(ts := ts, id := decision_id)) AS note
         FROM v_decisions WHERE trim(coalesce(note, '')) <> '' GROUP BY audit_id, flag_id) e
       ON f.audit_id = e.audit_id AND f.flag_id = e.flag_id""",
    BOTH,
)
def _(v):
    edits = v.decisions().withColumnRenamed("note", "text")
    return R.apply_decisions(v.decision_flags(), R.edits_as_decisions(edits)).select(
        "audit_id", "flag_id", "status", "reviewer_note"
    )

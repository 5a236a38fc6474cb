"""Registered queries: passports, digests, stages (A54, A70-A72, B10, B14 batch, B15 batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridraft.operators import activity, passports, stages
from veridraft.operators.paragraphs import paragraphs
from veridraft.plans.registry import query

C = F.col


def _issued(v):
    """Issued passports; those of documents not in English were issued under another token."""
    issued = v.passport_requests().join(v.table("documents").select("doc_id", "lang"), "doc_id")
    return issued.withColumn("token", F.when(C("lang") == "en", C("token")).otherwise(F.concat(F.lit("OLD-"), "token")))


def _requests(v):
    """All request tokens; altered ones are cut to four characters."""
    return v.passport_requests().select(
        "doc_id", F.when(C("is_altered"), F.substring("token", 1, 4)).otherwise(C("token")).alias("token")
    )


VERIFIED_SQL = """req AS (SELECT doc_id, CASE WHEN is_altered THEN substr(token, 1, 4) ELSE token END AS token FROM v_passport_requests),
  iss AS (SELECT CASE WHEN d.lang = 'en' THEN r.token ELSE concat('OLD-', r.token) END AS token, r.unresolved_flags_count
      FROM v_passport_requests r JOIN documents d ON r.doc_id = d.doc_id),
  ver AS (SELECT req.doc_id, req.token, CASE WHEN length(req.token) < 5 THEN 'INVALID' WHEN starts_with(req.token, 'TAMPER-') THEN 'TAMPERED'
     WHEN starts_with(req.token, 'INVALID-') OR iss.token IS NULL THEN 'INVALID' ELSE 'VERIFIED' END AS outcome, iss.unresolved_flags_count AS n
     FROM req LEFT JOIN iss ON req.token = iss.token)"""


@query(
    "a70_verify_passports",
    f"""WITH {VERIFIED_SQL} SELECT doc_id, token, outcome = 'VERIFIED' AS valid, outcome,
        CASE WHEN outcome = 'TAMPERED' THEN 'Document hash mismatch detected'
             WHEN outcome = 'INVALID' AND length(token) >= 5 THEN 'Token not found or has expired' END AS error_message,
        CASE WHEN outcome = 'VERIFIED' THEN n END AS unresolved_flags FROM ver""",
    ("v_passport_requests",),
)
def _(v):
    return passports.verify_passports(_requests(v), _issued(v))


@query(
    "a71_verification_trail",
    f"""WITH {VERIFIED_SQL} SELECT token, CAST(i AS INT) AS step_no, step, status, detail FROM (
        SELECT token, 1 AS i, 'Document SHA-256 Digest Validation' AS step, CASE outcome WHEN 'TAMPERED' THEN 'FAIL' ELSE 'PASS' END AS status,
          CASE outcome WHEN 'TAMPERED' THEN 'Hash mismatch detected' ELSE 'Hash matches cryptographic manifest' END AS detail FROM ver WHERE outcome <> 'INVALID'
        UNION ALL SELECT token, 2, 'Claim Hash Chain Inclusion Proof', CASE outcome WHEN 'TAMPERED' THEN 'WARN' ELSE 'PASS' END,
          CASE outcome WHEN 'TAMPERED' THEN 'Unable to verify' ELSE 'Claim digests verified in sequence' END FROM ver WHERE outcome <> 'INVALID'
        UNION ALL SELECT token, 3, 'ECDSA P-256 Validator Signature Verification', 'PASS', 'ECDSA P-256 / prime256v1 key signature confirmed' FROM ver WHERE outcome = 'VERIFIED'
        UNION ALL SELECT token, 4, 'Fact Reconciliation Anchor', CASE WHEN n > 0 THEN 'WARN' ELSE 'PASS' END,
          concat(n, ' unaddressed commercial/date variances logged') FROM ver WHERE outcome = 'VERIFIED') t""",
    ("v_passport_requests",),
)
def _(v):
    return passports.verification_trail(passports.verify_passports(_requests(v), _issued(v)))


@query(
    "b10_check_digests",
    """SELECT d.doc_id, sha256(d.text) AS actual_hash, r.is_altered AS is_tampered
       FROM documents d JOIN v_passport_requests r ON d.doc_id = r.doc_id""",
    ("v_passport_requests",),
)
def _(v):
    docs = v.table("documents")
    stated = docs.join(v.passport_requests().select("doc_id", "is_altered"), "doc_id").select(
        "doc_id",
        F.concat(
            F.lit("sha256:"),
            F.sha2(F.when(C("is_altered"), F.concat("text", F.lit("x"))).otherwise(C("text")), 256),
        ).alias("document_hash"),
    )
    return passports.check_digests(docs, stated, "doc_id")


CHAIN = "list_reduce(list_prepend('', {0}), lambda h, x: sha256(h || x))"


def _root_sql(fan_out: int, levels: int) -> str:
    """Blocks of ``fan_out``, chained on every level."""
    ctes = ["l0 AS (SELECT doc_id, para_no - 1 AS n, para AS x FROM v_paragraphs)"]
    for level in range(levels):
        ctes.append(
            f"l{level + 1} AS (SELECT doc_id, b AS n, {CHAIN.format('p')} AS x FROM (SELECT doc_id, n // {fan_out} AS b,"
            f" list(x ORDER BY n) AS p FROM l{level} GROUP BY doc_id, n // {fan_out}) g)"
        )
    return f"WITH {', '.join(ctes)} SELECT doc_id, x AS claim_tree_root FROM l{levels}"


@query("b10_claim_root", _root_sql(1024, 7), ("v_paragraphs",))
def _(v):
    return passports.claim_root(paragraphs(v.table("documents"), "doc_id", "text", "\n"), "doc_id", "para_no", "para")


@query("b10_claim_root_blocks", _root_sql(4, 6), ("v_paragraphs",))
def _(v):
    # blocks of four, to exercise the levels
    lines = paragraphs(v.table("documents"), "doc_id", "text", "\n")
    return passports.claim_root(lines, "doc_id", "para_no", "para", fan_out=4, levels=6)


DONE_SQL = """done AS (SELECT audit_id, max(CASE status WHEN 'UPLOADING' THEN 1 WHEN 'PARSING' THEN 2 WHEN 'CANONICALIZING' THEN 3 WHEN 'EXTRACTING_FACTS' THEN 4
    WHEN 'INDEXING' THEN 5 WHEN 'VERIFYING' THEN 6 WHEN 'COMPLETED' THEN 6 ELSE 0 END) AS done FROM v_stage_events GROUP BY audit_id)"""


@query(
    "a72_stage_board",
    f"""WITH {DONE_SQL} SELECT audit_id, CAST(s.i AS INT) AS stage_no,
        ['UPLOADING', 'PARSING', 'CANONICALIZING', 'EXTRACTING_FACTS', 'INDEXING', 'VERIFYING'][s.i] AS stage,
        CASE WHEN done >= s.i THEN 'done' WHEN done + 1 = s.i THEN 'current' ELSE 'pending' END AS state,
        CASE WHEN done >= 6 THEN 'READY' ELSE concat(CAST(round(100.0 * done / 6) AS INT), '%') END AS progress
        FROM done CROSS JOIN range(1, 7) s(i)""",
    ("v_stage_events",),
)
def _(v):
    return stages.stage_board(v.stage_events()).drop("label")


STAGE_SQL = """SELECT audit_id, max(CASE status WHEN 'QUEUED' THEN 0 WHEN 'UPLOADING' THEN 1 WHEN 'PARSING' THEN 2 WHEN 'INDEXING' THEN 5
      WHEN 'VERIFYING' THEN 7 WHEN 'COMPLETED' THEN 8 ELSE -1 END) AS stage_rank, epoch_us(max(ts)) AS last_us, count(*) AS events
   FROM v_stage_events GROUP BY audit_id"""
STAGE_NAMES = "['QUEUED', 'UPLOADING', 'PARSING', 'CANONICALIZING', 'EXTRACTING_FACTS', 'INDEXING', 'RETRIEVING', 'VERIFYING', 'COMPLETED']"
STAGE_STATUS_SQL = f"SELECT *, {STAGE_NAMES}[stage_rank + 1] AS stage FROM ({STAGE_SQL}) x"


@query("b14_stage_status", STAGE_STATUS_SQL, ("v_stage_events",))
def _(v):
    return stages.furthest_stage(v.stage_events()).withColumn("last_us", F.unix_micros("last_ts")).drop("last_ts")


@query(
    "b14_stuck_audits",
    f"""SELECT audit_id, stage_rank FROM ({STAGE_SQL}) x WHERE stage_rank < 8
        AND last_us < (SELECT epoch_us(max(ts)) FROM v_stage_events) - 86400000000""",
    ("v_stage_events",),
)
def _(v):
    events = v.stage_events()
    now = events.agg(F.max("ts")).scalar()
    return stages.stuck_audits(stages.furthest_stage(events), now, 86400).select("audit_id", "stage_rank")


@query(
    "b15_tumbling_activity",
    """SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, reviewed_by, action, count(*) AS decisions FROM v_decisions GROUP BY ALL""",
    ("v_decisions",),
)
def _(v):
    return activity.tumbling_activity(v.decisions()).select(
        F.unix_micros("window_start").alias("start_us"), "reviewed_by", "action", "decisions"
    )


@query(
    "b15_sliding_activity",
    """SELECT epoch_us(time_bucket(INTERVAL '30 minutes', ts)) - k * 1800000000 AS start_us, reviewed_by, action, count(*) AS decisions
       FROM v_decisions CROSS JOIN range(0, 2) r(k) GROUP BY ALL""",
    ("v_decisions",),
)
def _(v):
    return activity.tumbling_activity(v.decisions(), "1 hour", "30 minutes").select(
        F.unix_micros("window_start").alias("start_us"), "reviewed_by", "action", "decisions"
    )


def session_sql(keys: str) -> str:
    return f"""SELECT {keys}, CAST(session_no AS BIGINT) AS session_no, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS decisions FROM (
         SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no FROM (
           SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {keys} ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS new FROM v_decisions) a) b
       GROUP BY {keys}, session_no"""


def _sessions(v, keys: tuple[str, ...]):
    return activity.session_activity(v.decisions(), keys=keys).select(
        *keys, "session_no", F.unix_micros("session_start").alias("start_us"),
        F.unix_micros("last_decision").alias("last_us"), "decisions",
    )


@query("b15_session_activity", session_sql("reviewed_by, action"), ("v_decisions",))
def _(v):
    return _sessions(v, ("reviewed_by", "action"))


@query("b15_reviewer_sessions", session_sql("reviewed_by"), ("v_decisions",))
def _(v):
    return _sessions(v, ("reviewed_by",))

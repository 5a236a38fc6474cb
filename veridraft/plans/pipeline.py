"""Registered queries: documents to verdicts, flags and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridraft.operators import audit_pipeline as E
from veridraft.operators import scoring as S
from veridraft.operators import triage as T
from veridraft.operators.verdicts import AMOUNT, UNITS
from veridraft.plans.documents import _SQL_PATTERNS, SENTENCES
from veridraft.plans.labels import RANK_SQL, band_sql
from veridraft.plans.registry import query
from veridraft.plans.retrieval import _TOKENS

C = F.col


def _claims_sql(name: str, key: str, table: str) -> str:
    """CTEs that end in ``{name}``: typed claims of a table with a text column."""
    sentences = SENTENCES.format(key=key, text="text", table=table).replace("parts", f"{name}_parts").replace("sent AS", f"{name}_sent AS")
    hits = " UNION ALL ".join(
        f"SELECT {key}, sentence_no, sentence, {i} AS c, '{category}' AS category, v, unnest(range(1, len(v) + 1)) AS j FROM"
        f" (SELECT {key}, sentence_no, sentence, regexp_extract_all(sentence, '{pattern}') AS v FROM {name}_sent) x"
        for i, (category, pattern) in enumerate(_SQL_PATTERNS)
    )
    unit = " ".join(f"WHEN '{u}' THEN {n}" for u, n in UNITS.items())
    days = "['%d %b %Y', '%d %B %Y', '%b %d, %Y', '%B %d, %Y', '%Y-%m-%d']"
    return f"""{sentences}, {name}_hits AS ({hits}),
      {name}_vals AS (SELECT {key}, sentence_no, sentence, category, v[j] AS value,
        row_number() OVER (PARTITION BY {key}, sentence_no ORDER BY c, j) AS value_no FROM {name}_hits),
      {name} AS (SELECT *, concat_ws('-', {key}, sentence_no, value_no) AS claim_id,
        CASE WHEN category IN ('COMMERCIAL_VALUE', 'SLA_GUARANTEE') THEN
          CAST(CAST(replace(regexp_extract(value, '{AMOUNT}', 1), ',', '') AS DECIMAL(26, 6))
            * CAST(CASE regexp_extract(value, '{AMOUNT}', 2) {unit} ELSE 1 END AS DECIMAL(11, 0)) AS DECIMAL(38, 6)) END AS amount,
        CASE WHEN category = 'DELIVERY_DATE' THEN CAST(try_strptime(value, {days}) AS DATE) END AS day FROM {name}_vals)"""


def _context_sql(name: str, table: str) -> str:
    """A CTE with the words around each value."""
    n = E.CONTEXT_CHARS
    around = f"substr(sentence, greatest(1, spot - {n}), least({n}, spot - 1)) || ' ' || substr(sentence, spot + length(value), {n})"
    return f"""{name} AS (SELECT *, list_distinct({_TOKENS.replace('text', around)}) AS ctx
      FROM (SELECT *, strpos(sentence, value) AS spot FROM {table}) x)"""


VERDICTS = f"""{_claims_sql('clm', 'doc_id', 'documents')}, {_claims_sql('src', 'item_id', 'benchmark')},
  pw AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
  st AS (SELECT avg(len(w)) AS mean_len, count(*) AS n FROM pw),
  post AS (SELECT item_id, term, len, count(*) AS tf FROM (SELECT item_id, len(w) AS len, unnest(w) AS term FROM pw) a GROUP BY item_id, term, len),
  wgt AS (SELECT item_id, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_len)) AS weight FROM post, st),
  terms AS (SELECT term, ln(1 + ((SELECT n FROM st) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post GROUP BY term),
  q AS (SELECT DISTINCT claim_id, unnest({_TOKENS.replace('lower(text)', 'lower(sentence)')}) AS term FROM clm),
  sc AS (SELECT q.claim_id, wgt.item_id, round(sum(terms.idf * wgt.weight), 6) AS score
         FROM q JOIN terms ON q.term = terms.term JOIN wgt ON q.term = wgt.term GROUP BY q.claim_id, wgt.item_id),
  hit AS (SELECT claim_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, item_id) AS r FROM sc) x WHERE r <= 3),
  {_context_sql('cc', 'clm')}, {_context_sql('cs', 'src')},
  pairs AS (SELECT c.doc_id, c.sentence_no, s.item_id, c.category, list([{{'o': -len(list_intersect(c.ctx, s.ctx)), 'c': c.value_no, 's': s.sentence_no,
        'v': s.value_no, 'id': c.claim_id, 'a': s.amount, 'd': s.day}}] ORDER BY len(list_intersect(c.ctx, s.ctx)) DESC, c.value_no, s.sentence_no, s.value_no) AS p
      FROM cc c JOIN hit h ON c.claim_id = h.claim_id JOIN cs s ON h.item_id = s.item_id AND c.category = s.category
      WHERE len(list_intersect(c.ctx, s.ctx)) > 0 GROUP BY c.doc_id, c.sentence_no, s.item_id, c.category),
  aligned AS (SELECT item_id, unnest(list_reduce(p, lambda done, x: CASE WHEN len(list_filter(done, lambda y:
        y.c = x[1].c OR (y.s = x[1].s AND y.v = x[1].v))) > 0 THEN done ELSE list_concat(done, x) END)) AS m FROM pairs),
  truth AS (SELECT * FROM (SELECT m.id AS claim_id, item_id, m.a AS amount, m.d AS day, row_number() OVER (PARTITION BY m.id ORDER BY
        CASE item_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, item_id % 7 DESC, concat('SRC-', item_id)) AS r FROM aligned) x WHERE r = 1),
  ver AS (SELECT c.doc_id, c.claim_id, c.category, c.value, 'SRC-' || t.item_id AS source_id,
      CASE WHEN t.claim_id IS NULL THEN 'UNSUPPORTED' WHEN c.amount - t.amount IS NULL AND date_diff('day', t.day, c.day) IS NULL THEN 'UNCERTAIN'
        WHEN coalesce(c.amount - t.amount, 0) = 0 AND coalesce(date_diff('day', t.day, c.day), 0) = 0 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS verdict,
      CAST(c.amount - t.amount AS DOUBLE) AS delta_amount, CAST(date_diff('day', t.day, c.day) AS INT) AS delta_days
    FROM clm c LEFT JOIN truth t ON c.claim_id = t.claim_id)"""
FLAGS = f"""{VERDICTS}, fl AS (SELECT concat('DOC-', doc_id) AS audit_id, concat('FLG-', claim_id) AS flag_id, claim_id,
    CASE verdict WHEN 'CONTRADICTED' THEN 'CRITICAL' WHEN 'UNSUPPORTED' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    CAST(CASE verdict WHEN 'CONTRADICTED' THEN -10 WHEN 'UNSUPPORTED' THEN -3 ELSE -1 END AS INT) AS impact_score, source_id
    FROM ver WHERE verdict <> 'SUPPORTED')"""
AUDITS = """au AS (SELECT doc_id AS seq, concat('DOC-', doc_id) AS audit_id,
    CASE lang WHEN 'en' THEN 'CRITICAL' WHEN 'de' THEN 'HIGH' WHEN 'fr' THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM documents)"""


def _sources(v):
    """benchmark passages as sources, of three authorities and seven dates."""
    return v.table("benchmark").selectExpr(
        "concat('SRC-', item_id) AS source_key", "text",
        "element_at(array('SIGNED_EXECUTED', 'LATEST_APPROVED', 'SUPERSEDED'), CAST(item_id % 3 + 1 AS INT)) AS authority",
        "date_add(DATE '2026-01-01', CAST(item_id % 7 AS INT)) AS freshness_date",
    )


def _verdicts(v):
    claims = E.document_claims(v.table("documents"), "doc_id", "text")
    return E.audit_claims(claims, _sources(v), "source_key", "text")


def _flags(v):
    return E.verdict_flags(_verdicts(v), "doc_id", F.concat(F.lit("DOC-"), "doc_id"))


@query(
    "e3_verdicts",
    f"WITH {VERDICTS} SELECT claim_id, category, value, source_id, verdict, delta_amount, delta_days FROM ver",
)
def _(v):
    return _verdicts(v).select("claim_id", "category", "value", "source_id", "verdict", "delta_amount", "delta_days")


@query("e3_flags", f"WITH {FLAGS} SELECT * FROM fl")
def _(v):
    return _flags(v).drop("status")


@query(
    "e3_audit_documents",
    f"""WITH {FLAGS}, {AUDITS}, r AS (SELECT a.seq, a.audit_id, a.priority, count(f.flag_id) AS findings_count,
          CAST(greatest(0, least(100, 100 + coalesce(sum(f.impact_score), 0))) AS INT) AS score
        FROM au a LEFT JOIN fl f ON a.audit_id = f.audit_id GROUP BY a.seq, a.audit_id, a.priority)
      SELECT row_number() OVER (ORDER BY {RANK_SQL.format('priority')}, seq DESC) AS position, audit_id, priority,
        score AS trust_score, {band_sql('score')} AS risk_band, findings_count,
        CASE WHEN findings_count = 0 THEN 'VERIFIED' ELSE 'REVIEW REQUIRED' END AS status FROM r""",
)
def _(v):
    """Documents in, ranked review queue out."""
    audits = v.table("documents").selectExpr(
        "doc_id AS seq", "concat('DOC-', doc_id) AS audit_id",
        "CASE lang WHEN 'en' THEN 'CRITICAL' WHEN 'de' THEN 'HIGH' WHEN 'fr' THEN 'MEDIUM' ELSE 'LOW' END AS priority",
    )
    return T.review_queue(S.rescore(audits, _flags(v))).select(
        "position", "audit_id", "priority", "trust_score", "risk_band", "findings_count", "status"
    )

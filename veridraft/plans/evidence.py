"""Registered queries: evidence, joins, roll-ups, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridraft.operators import evidence as E
from veridraft.operators import regions as G
from veridraft.plans.labels import LOCATION_SQL, RANK_SQL, VERDICT_SQL
from veridraft.plans.registry import query

C = F.col


@query(
    "a25_evidence_view",
    f"""SELECT audit_id, flag_id, {VERDICT_SQL} AS verdict, coalesce(trim(ev_quote) <> '', FALSE) AS has_quote,
        CASE WHEN ev_authority <> '' THEN ev_authority ELSE 'Approved Source' END AS authority,
        CASE WHEN ev_authority <> '' THEN ev_authority ELSE ev_name END AS card_authority,
        coalesce(ev_fresh, 'Current') AS freshness, CAST(round(ev_relevance * 100) AS INT) AS relevance_percent,
        {LOCATION_SQL} AS location_text,
        CASE WHEN has_counter THEN CASE WHEN verification_status = 'CONTRADICTED' THEN 'CONTRADICTING' ELSE 'UNCERTAIN' END END AS counter_relation
        FROM v_rich""",
    ("v_rich",),
)
def _(v):
    return E.evidence_view(v.rich_flags())


@query(
    "a51_evidence_source_first",
    """SELECT f.flag_id, s.source_id, s.name, s.authority FROM v_flags f
       LEFT JOIN (SELECT x.audit_id, x.source_id, s.name, s.authority FROM v_audit_sources x JOIN v_sources s ON x.source_id = s.source_id WHERE x.ord = 0) s
       ON f.audit_id = s.audit_id""",
    ("v_flags", "v_sources", "v_audit_sources"),
)
def _(v):
    sources = v.audit_sources(with_ord=True).join(v.sources(), "source_id")
    return E.evidence_source(v.flags(), sources, "first").select("flag_id", "source_id", "name", "authority")


@query(
    "a51_evidence_source_cited",
    """SELECT f.flag_id, f.source_id, s.name, s.authority FROM v_flags f
       LEFT JOIN (SELECT x.audit_id, x.source_id, s.name, s.authority FROM v_audit_sources x JOIN v_sources s ON x.source_id = s.source_id) s
       ON f.audit_id = s.audit_id AND f.source_id = s.source_id""",
    ("v_flags", "v_sources", "v_audit_sources"),
)
def _(v):
    sources = v.audit_sources().join(v.sources(), "source_id")
    return E.evidence_source(v.flags(), sources, "cited").select("flag_id", "source_id", "name", "authority")


@query(
    "a52_checklist_flags",
    """SELECT i.item_id, i.flag_id, f.severity AS flag_severity, f.status AS flag_status, f.flag_id IS NOT NULL AS has_flag
       FROM v_check_items i LEFT JOIN v_flags f ON i.audit_id = f.audit_id AND i.flag_id = f.flag_id""",
    ("v_check_items", "v_flags"),
)
def _(v):
    return E.checklist_flags(v.check_items(), v.flags()).select(
        "item_id", "flag_id", "flag_severity", "flag_status", "has_flag"
    )


def _passports(v):
    """A passport for every verified audit; audits with a reviewed score have two."""
    verified = v.audits().where("status = 'VERIFIED'")
    copies = F.when(C("reviewed_score").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return verified.select("*", F.explode(copies).alias("copy")).selectExpr(
        "concat('PASSPORT-', CAST(seq AS STRING), '-', CAST(copy AS STRING)) AS token", "copy AS ord", "audit_id",
        "document_name", "concat('sha256:', sha2(title, 256)) AS document_hash",
        "trust_score + copy AS trust_score", "'VERIFIED' AS status", "10 AS total_claims_checked",
        "9 AS verified_claims_count", "trust_score % 3 AS unresolved_flags_count",
    )


@query(
    "a53_get_passport",
    """SELECT lower(audit_id) AS audit_id,
       CASE WHEN status = 'VERIFIED' THEN concat('PASSPORT-', seq, '-0') ELSE concat('PASSPORT-00000-', lower(audit_id)) END AS token,
       CASE WHEN status = 'VERIFIED' THEN document_name ELSE 'AI_Verified_Document.pdf' END AS document_name,
       concat('sha256:', CASE WHEN status = 'VERIFIED' THEN sha256(title) ELSE sha256('') END) AS document_hash,
       CASE WHEN status = 'VERIFIED' THEN trust_score ELSE 72 END AS trust_score, 'VERIFIED' AS status,
       CASE WHEN status = 'VERIFIED' THEN 10 ELSE 8 END AS total_claims_checked,
       CASE WHEN status = 'VERIFIED' THEN 9 ELSE 7 END AS verified_claims_count,
       CASE WHEN status = 'VERIFIED' THEN trust_score % 3 ELSE 1 END AS unresolved_flags_count,
       status <> 'VERIFIED' AS is_fallback FROM v_audits""",
    ("v_audits",),
)
def _(v):
    asked = v.audits().select(F.lower("audit_id").alias("audit_id"))
    return E.get_passport(asked, _passports(v))


@query(
    "a55_evidence_graph",
    """SELECT c.audit_id, concat('doc:', a.document_name) AS src, concat('claim:', c.claim_id) AS dst, NULL AS label
       FROM v_claims c JOIN v_audits a ON c.audit_id = a.audit_id
       UNION ALL
       SELECT audit_id, concat('claim:', claim_id), concat('source:', source_id), concat('Contradicts ', source_id) FROM v_rich""",
    ("v_audits", "v_claims", "v_rich"),
)
def _(v):
    return E.evidence_graph(v.audits(), v.claims(), v.rich_flags())


PLACE_SQL = """CASE loc_type WHEN 'pdf' THEN concat('page ', loc_n) WHEN 'docx' THEN concat('paragraph ', loc_n)
   WHEN 'xlsx' THEN concat('sheet ', loc_sheet) WHEN 'text' THEN 'text' ELSE 'unknown' END"""


@query(
    "b03_location_heatmap",
    f"""SELECT audit_id, place, count(*) AS finding_count,
        ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFORMATIONAL'][min({RANK_SQL.format('severity')}) + 1] AS worst_severity
        FROM (SELECT *, {PLACE_SQL} AS place FROM v_rich) x GROUP BY audit_id, place""",
    ("v_rich",),
)
def _(v):
    return E.location_heatmap(v.rich_flags())


@query("b03_location_flags", f"SELECT audit_id, {PLACE_SQL} AS place, flag_id, severity FROM v_rich", ("v_rich",))
def _(v):
    return E.location_flags(v.rich_flags())


#: One crowded document per supplier, with intervals and boxes made from its lines.
_SPOTS_SQL = f"""spots AS (SELECT concat('AUD-', l_suppkey % 10) AS audit_id, CASE WHEN l_linenumber % 2 = 0 THEN 'text' ELSE concat('paragraph ', CAST(l_quantity AS INT)) END AS place,
      concat_ws('-', 'FLG', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flag_id, {{rank}} AS r,
      CAST(l_partkey * 37 % 50021 AS INT) AS a, CAST(l_partkey * 37 % 50021 + CAST(l_quantity AS INT) - 5 AS INT) AS b FROM (
        SELECT *, CASE WHEN l_discount >= 0.09 THEN 'CRITICAL' WHEN l_discount >= 0.07 THEN 'HIGH' WHEN l_discount >= 0.04 THEN 'MEDIUM'
          WHEN l_discount >= 0.02 THEN 'LOW' ELSE 'INFORMATIONAL' END AS severity FROM lineitem) l),
   isl AS (SELECT *, sum(new) OVER (PARTITION BY audit_id, place ORDER BY a, b, flag_id ROWS UNBOUNDED PRECEDING) AS region_no FROM (
      SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY audit_id, place ORDER BY a, b, flag_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
      FROM spots WHERE a < b) x)""".replace("{rank}", RANK_SQL.format("severity"))


def _spots(v):
    lines = v.table("lineitem")
    kind = F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 'text' ELSE 'docx' END")
    start = F.expr("CAST(l_partkey * 37 % 50021 AS INT)")
    location = F.struct(
        kind.alias("type"), F.expr("CAST(l_quantity AS INT)").alias("paragraph"), F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("string").alias("sheet"), start.alias("char_start"),
        (start + F.expr("CAST(l_quantity AS INT)") - 5).alias("char_end"),
    )
    ids = F.expr("concat_ws('-', 'FLG', l_orderkey, l_linenumber, l_partkey, l_suppkey)")
    return lines.select(
        F.expr("concat('AUD-', l_suppkey % 10)").alias("audit_id"), ids.alias("flag_id"), location.alias("document_location"),
        F.expr("CASE WHEN l_discount >= 0.09 THEN 'CRITICAL' WHEN l_discount >= 0.07 THEN 'HIGH' WHEN l_discount >= 0.04 THEN 'MEDIUM'"
               " WHEN l_discount >= 0.02 THEN 'LOW' ELSE 'INFORMATIONAL' END").alias("severity"),
    )


@query(
    "b03_text_regions",
    f"""WITH {_SPOTS_SQL} SELECT audit_id, place, CAST(region_no AS BIGINT) AS region_no, min(a) AS char_start, max(b) AS char_end,
        count(*) AS finding_count, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFORMATIONAL'][min(r) + 1] AS worst_severity
        FROM isl GROUP BY audit_id, place, region_no""",
)
def _(v):
    return G.text_regions(_spots(v))


@query("b03_text_region_flags", f"WITH {_SPOTS_SQL} SELECT audit_id, place, CAST(region_no AS BIGINT) AS region_no, flag_id FROM isl")
def _(v):
    return G.text_region_flags(_spots(v))


_BOXES_SQL = """boxes AS (SELECT concat('AUD-', l_orderkey % 500) AS audit_id, concat('page ', l_linenumber) AS place,
      concat_ws('-', 'FLG', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flag_id, l_discount,
      l_partkey % 600 AS x, l_suppkey * 13 % 780 AS y, l_quantity AS w, l_orderkey % 40 AS h FROM lineitem),
   cov AS (SELECT audit_id, place, flag_id, l_discount, CAST(cy * 32 + cx AS INT) AS cell FROM boxes,
      range(0, 32) a(cx), range(0, 32) b(cy)
      WHERE cx BETWEEN least(31, CAST(floor(x * 32 / 612.0) AS INT)) AND least(31, CAST(floor((x + w) * 32 / 612.0) AS INT))
        AND cy BETWEEN least(31, CAST(floor(y * 32 / 792.0) AS INT)) AND least(31, CAST(floor((y + h) * 32 / 792.0) AS INT))),
   cel AS (SELECT DISTINCT audit_id, place, cell FROM cov),
   reach AS (SELECT audit_id, place, cell, cell AS other FROM cel
     UNION SELECT r.audit_id, r.place, r.cell, c.cell FROM reach r JOIN cel c ON r.audit_id = c.audit_id AND r.place = c.place
       AND (abs(c.cell - r.other) = 32 OR (abs(c.cell - r.other) = 1 AND c.cell // 32 = r.other // 32))),
   reg AS (SELECT audit_id, place, cell, min(other) AS region FROM reach GROUP BY audit_id, place, cell)"""


@query(
    "b03_page_regions",
    f"""WITH RECURSIVE {_BOXES_SQL}
        SELECT f.audit_id, f.place, f.region, f.finding_count, f.worst_severity, a.cells FROM (
          SELECT audit_id, place, region, count(*) AS finding_count, CASE WHEN max(l_discount) >= 0.09 THEN 'CRITICAL' WHEN max(l_discount) >= 0.07 THEN 'HIGH'
            WHEN max(l_discount) >= 0.04 THEN 'MEDIUM' WHEN max(l_discount) >= 0.02 THEN 'LOW' ELSE 'INFORMATIONAL' END AS worst_severity
          FROM (SELECT DISTINCT v.audit_id, v.place, v.flag_id, v.l_discount, g.region FROM cov v JOIN reg g ON v.audit_id = g.audit_id AND v.place = g.place AND v.cell = g.cell) d
          GROUP BY audit_id, place, region) f
        JOIN (SELECT audit_id, place, region, count(*) AS cells FROM reg GROUP BY audit_id, place, region) a
          ON f.audit_id = a.audit_id AND f.place = a.place AND f.region = a.region""",
)
def _(v):
    boxed = v.table("lineitem").selectExpr(
        "concat('AUD-', l_orderkey % 500) AS audit_id", "concat_ws('-', 'FLG', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flag_id",
        "CASE WHEN l_discount >= 0.09 THEN 'CRITICAL' WHEN l_discount >= 0.07 THEN 'HIGH' WHEN l_discount >= 0.04 THEN 'MEDIUM'"
        " WHEN l_discount >= 0.02 THEN 'LOW' ELSE 'INFORMATIONAL' END AS severity",
        "named_struct('type', 'pdf', 'page', CAST(l_linenumber AS INT), 'paragraph', CAST(NULL AS INT), 'sheet', CAST(NULL AS STRING),"
        " 'char_start', CAST(NULL AS INT), 'char_end', CAST(NULL AS INT), 'bbox', array(CAST(l_partkey % 600 + l_quantity AS DOUBLE),"
        " CAST(l_suppkey * 13 % 780 AS DOUBLE), CAST(l_partkey % 600 AS DOUBLE), CAST(l_suppkey * 13 % 780 + l_orderkey % 40 AS DOUBLE))) AS document_location",
    )
    return G.page_regions(boxed)


@query(
    "b08_source_precedence",
    """SELECT group_key, source_id, CASE authority WHEN 'LATEST_APPROVED' THEN 0 WHEN 'SIGNED_EXECUTED' THEN 1 WHEN 'DRAFT' THEN 2 ELSE 3 END AS authority_rank,
       authority, candidates FROM (
         SELECT n.l_orderkey AS group_key, s.source_id, s.authority, count(*) OVER (PARTITION BY n.l_orderkey) AS candidates,
           row_number() OVER (PARTITION BY n.l_orderkey ORDER BY CASE s.authority WHEN 'LATEST_APPROVED' THEN 0 WHEN 'SIGNED_EXECUTED' THEN 1 WHEN 'DRAFT' THEN 2 ELSE 3 END,
             CAST(n.l_shipdate AS DATE) DESC, s.source_id) AS r
         FROM lineitem n JOIN v_sources s ON s.source_id = concat('SRC-', CAST(n.l_suppkey AS STRING))) x WHERE r = 1""",
    ("v_sources",),
)
def _(v):
    cited = v.table("lineitem").selectExpr(
        "l_orderkey AS group_key", "concat('SRC-', CAST(l_suppkey AS STRING)) AS source_id",
        "CAST(l_shipdate AS DATE) AS freshness_date",
    )
    candidates = cited.join(v.sources().select("source_id", "authority"), "source_id")
    return E.source_precedence(candidates, ["group_key"]).select(
        "group_key", "source_id", "authority_rank", "authority", "candidates"
    )


@query(
    "b11_policy_rollup",
    "SELECT policy_name, "
    + ", ".join(f"count(*) FILTER (policy_status = '{s}') AS n_{s.lower()}" for s in E.POLICY_STATUSES)
    + """, ['VIOLATED', 'AT_RISK', 'COMPLIANT'][min(CASE policy_status WHEN 'VIOLATED' THEN 1 WHEN 'AT_RISK' THEN 2 ELSE 3 END)] AS worst_status
       FROM v_policy_rows GROUP BY policy_name""",
    ("v_rich", "v_policy_rows"),
)
def _(v):
    return E.policy_rollup(v.rich_flags())


@query(
    "b11_omission_rollup",
    """SELECT confidence, count(*) AS omissions, count(*) FILTER (needs_human) AS need_review FROM v_rich WHERE has_omission GROUP BY confidence""",
    ("v_rich",),
)
def _(v):
    return E.omission_rollup(v.rich_flags())


@query(
    "b13_integrity_report",
    """SELECT 'FLAG_WITHOUT_CLAIM' AS kind, audit_id, flag_id AS item_id, claim_id AS detail FROM v_rich r
         WHERE NOT EXISTS (SELECT 1 FROM v_claims c WHERE c.audit_id = r.audit_id AND c.claim_id = r.claim_id)
       UNION ALL SELECT 'ITEM_WITHOUT_FLAG', audit_id, item_id, flag_id FROM v_check_items i
         WHERE NOT EXISTS (SELECT 1 FROM v_rich r WHERE r.audit_id = i.audit_id AND r.flag_id = i.flag_id)
       UNION ALL SELECT 'FINDINGS_COUNT', a.audit_id, a.audit_id, concat('stated ', a.trust_score % 8, ', actual ', coalesce(n, 0))
         FROM v_audits a LEFT JOIN (SELECT audit_id, count(*) AS n FROM v_rich GROUP BY audit_id) x ON a.audit_id = x.audit_id
         WHERE a.trust_score % 8 <> coalesce(n, 0)""",
    ("v_audits", "v_claims", "v_rich", "v_check_items"),
)
def _(v):
    audits = v.audits().withColumn("findings_count", C("trust_score") % 8)
    return E.integrity_report(audits, v.claims(), v.rich_flags(), v.check_items())

"""The adapter views as SQL for the comparison engine (see ``sources.adapters``)."""

VIEWS = {
    "v_audits": """
SELECT o_orderkey AS seq, concat('AUD-', CAST(o_orderkey AS STRING)) AS audit_id,
       concat(c_name, ' ', c_mktsegment) AS title,
       concat('doc_', CAST(o_orderkey AS STRING),
              CASE o_orderkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.docx' ELSE '.bin' END) AS document_name,
       CASE o_orderstatus WHEN 'P' THEN 'PROCESSING' WHEN 'O' THEN 'REVIEW REQUIRED' ELSE 'VERIFIED' END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM'
                            WHEN '5-LOW' THEN 'LOW' ELSE 'INFORMATIONAL' END AS priority,
       CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INT) AS trust_score,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST((CAST(floor(o_totalprice) AS BIGINT) + 17) % 101 AS INT) END AS reviewed_score,
       o_orderdate AS uploaded_at
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_flags": """
SELECT concat('AUD-', CAST(l_orderkey AS STRING)) AS audit_id,
       concat('FLG-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS flag_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS ord,
       CASE WHEN l_discount >= 0.09 THEN 'CRITICAL' WHEN l_discount >= 0.07 THEN 'HIGH' WHEN l_discount >= 0.04 THEN 'MEDIUM'
            WHEN l_discount >= 0.02 THEN 'LOW' ELSE 'INFORMATIONAL' END AS severity,
       CASE WHEN l_returnflag = 'N' THEN 'PENDING' WHEN l_returnflag = 'A' THEN 'ACCEPTED'
            WHEN l_linestatus = 'F' THEN 'FIXED' ELSE 'DISMISSED' END AS status,
       -CAST(floor(l_quantity / 3) AS INT) AS impact_score,
       concat('SRC-', CAST(l_suppkey AS STRING)) AS source_id
FROM lineitem""",
    "v_claims": """
SELECT concat(CASE WHEN l_linestatus = 'O' THEN 'AUD-' ELSE 'GONE-' END, CAST(l_orderkey AS STRING)) AS audit_id,
       concat('CLM-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS claim_id,
       l_linenumber AS claim_number
FROM lineitem""",
    "v_sources": """
SELECT concat('SRC-', CAST(s_suppkey AS STRING)) AS source_id, concat(s_name, CASE s_suppkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xlsx' ELSE '.docx' END) AS name,
       CASE s_suppkey % 4 WHEN 0 THEN 'LATEST_APPROVED' WHEN 1 THEN 'SIGNED_EXECUTED' WHEN 2 THEN 'SUPERSEDED' ELSE 'DRAFT' END AS authority,
       CAST(1000000 + s_suppkey * 977777 AS BIGINT) AS size_bytes, s_nationkey AS group_key
FROM supplier""",
    "v_audit_sources": """
SELECT concat(CASE WHEN gone THEN 'GONE-' ELSE 'AUD-' END, CAST(l_orderkey AS STRING)) AS audit_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey, gone ORDER BY l_suppkey) - 1 AS INT) AS ord,
       concat('SRC-', CAST(l_suppkey AS STRING)) AS source_id
FROM (SELECT DISTINCT l_orderkey, l_returnflag = 'N' AS gone, l_suppkey FROM lineitem) d""",
    "v_decision_flags": """
SELECT DISTINCT concat('AUD-', CASE WHEN user_id % 31 = 0 THEN 'none' ELSE CAST(user_id % 10 AS STRING) END) AS audit_id,
       concat(CASE WHEN user_id % 29 = 0 THEN 'GONE-' ELSE 'FLG-' END, CAST(user_id AS STRING)) AS flag_id,
       CAST(-(1 + user_id % 12) AS INT) AS impact_score
FROM events""",
    "v_decisions": """
SELECT event_id AS decision_id, concat('AUD-', CAST(user_id % 10 AS STRING)) AS audit_id, concat('FLG-', CAST(user_id AS STRING)) AS flag_id,
       CASE event_type WHEN 'click' THEN 'ACCEPT' WHEN 'view' THEN 'DISMISS' WHEN 'purchase' THEN 'FIX' ELSE event_type END AS action,
       CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN NULL ELSE props END AS note,
       concat('reviewer-', CAST(event_id % 7 AS STRING)) AS reviewed_by, ts
FROM events""",
    "v_doc_flags": """
SELECT d.doc_id, concat(d.doc_id, '-', i) AS flag_id, CAST(i * 7 % 13 * 1000000 + i AS INT) AS ord, p[i] AS claim,
       CASE WHEN l.toxic = 1 THEN 'CRITICAL' WHEN l.quality = 0 THEN 'HIGH' WHEN (i - 1) % 3 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CASE WHEN (i - 1) % 2 = 0 THEN 'PENDING' ELSE 'ACCEPTED' END AS status
FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) a) d
LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE p[i] <> ''""",
    "v_paragraphs": """
SELECT doc_id, CAST(i AS INT) AS para_no, p[i] AS para
FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
      FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p FROM documents) a) b""",
    "v_matches": """
SELECT p.doc_id, p.para_no, arg_min(f.flag_id, f.ord) AS flag_id
FROM v_paragraphs p JOIN v_doc_flags f
  ON p.doc_id = f.doc_id AND contains(lower(p.para), substr(lower(f.claim), 1, 30))
GROUP BY p.doc_id, p.para_no""",
    "v_passport_requests": """
SELECT doc_id, concat(CASE WHEN doc_id % 11 = 0 THEN 'TAMPER-' WHEN doc_id % 13 = 0 THEN 'INVALID-' ELSE 'PASSPORT-' END, CAST(doc_id AS STRING)) AS token,
       doc_id % 17 = 0 AS is_altered, CAST(doc_id % 4 AS INT) AS unresolved_flags_count
FROM documents""",
    "v_rich": """
SELECT concat('AUD-', CAST(l_orderkey AS STRING)) AS audit_id,
       concat_ws('-', 'FLG', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flag_id,
       concat_ws('-', 'CLM', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id,
       CASE WHEN l_discount >= 0.09 THEN 'CRITICAL' WHEN l_discount >= 0.07 THEN 'HIGH' WHEN l_discount >= 0.04 THEN 'MEDIUM'
            WHEN l_discount >= 0.02 THEN 'LOW' ELSE 'INFORMATIONAL' END AS severity,
       concat('SRC-', CAST(l_suppkey AS STRING)) AS source_id,
       CASE WHEN l_tax > 0.06 THEN 'CONTRADICTED' WHEN l_tax > 0.05 THEN 'SUPPORTED' END AS verification_status,
       ['pdf', 'docx', 'xlsx', 'text', 'unknown'][l_linenumber % 5 + 1] AS loc_type,
       CAST(l_quantity AS INT) AS loc_n, CAST(l_suppkey AS INT) AS loc_start, CAST(l_suppkey + l_partkey AS INT) AS loc_end,
       concat('S', CAST(l_linenumber AS STRING)) AS loc_sheet, concat('B', CAST(CAST(l_quantity AS INT) AS STRING)) AS loc_cell,
       concat('Supplier ', CAST(l_suppkey AS STRING)) AS ev_name,
       CASE WHEN l_tax < 0.02 THEN '' WHEN l_tax < 0.04 THEN 'Signed' END AS ev_authority,
       CASE WHEN l_linestatus = 'O' THEN '22 Sep 2026' END AS ev_fresh,
       CASE l_returnflag WHEN 'R' THEN '  ' WHEN 'A' THEN NULL ELSE 'quoted text' END AS ev_quote,
       CASE WHEN l_tax > 0.03 THEN l_discount * 10 END AS ev_relevance,
       l_tax < 0.03 AS has_counter,
       CASE WHEN l_discount > 0.05 THEN CASE l_returnflag WHEN 'R' THEN 'Regulatory' WHEN 'A' THEN 'Operational' ELSE 'Commercial' END END AS materiality,
       l_quantity > 25 AS has_policy, concat('POLICY_', CAST(l_linenumber AS STRING)) AS policy1,
       CASE l_returnflag WHEN 'R' THEN 'VIOLATED' WHEN 'A' THEN 'AT_RISK' ELSE 'COMPLIANT' END AS policy1_status, l_linestatus AS policy1_why,
       l_quantity > 25 AND l_tax > 0.04 AS has_policy2, l_returnflag AS policy2_why,
       l_quantity < 10 AS has_omission, CASE l_returnflag WHEN 'R' THEN 'HIGH' WHEN 'A' THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
       l_linestatus = 'O' AS needs_human
FROM lineitem""",
    "v_policy_rows": """
SELECT audit_id, flag_id, 0 AS policy_ord, policy1 AS policy_name, policy1_why AS rationale, policy1_status AS policy_status FROM v_rich WHERE has_policy
UNION ALL
SELECT audit_id, flag_id, 1, 'POLICY_TAX', policy2_why, 'AT_RISK' FROM v_rich WHERE has_policy2""",
    "v_check_items": """
SELECT concat('AUD-', CAST(l_orderkey AS STRING)) AS audit_id,
       concat_ws('-', 'WTC', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id,
       concat_ws('-', CASE WHEN l_returnflag = 'R' THEN 'GONE' ELSE 'FLG' END, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flag_id,
       CAST(l_quantity * l_linenumber AS INT) AS "order"
FROM lineitem""",
    "v_stage_events": """
SELECT concat('AUD-', CAST(user_id AS STRING), '-', CAST(day(ts) AS STRING)) AS audit_id,
       CASE event_type WHEN 'signup' THEN 'UPLOADING' WHEN 'view' THEN 'PARSING' WHEN 'click' THEN 'INDEXING' WHEN 'error' THEN 'QUEUED'
            ELSE CASE WHEN value < 20 THEN 'VERIFYING' ELSE 'COMPLETED' END END AS status, ts
FROM events""",
    "v_new": """
SELECT seq, concat('NEW-', CAST(seq AS STRING)) AS audit_id,
       CASE WHEN seq % 5 = 0 THEN '' WHEN seq % 7 = 0 THEN NULL ELSE title END AS title,
       document_name AS file_name,
       CASE WHEN seq % 2 = 0 THEN '2.4 MB' ELSE CAST(seq * 1000 AS STRING) END AS file_size
FROM v_audits""",
    "v_new_files": """
SELECT replace(a.audit_id, 'AUD-', 'NEW-') AS audit_id, a.ord, a.source_id, s.name,
       CASE WHEN s.group_key % 2 = 0 THEN CAST(s.size_bytes AS STRING) ELSE '1.2 MB' END AS size,
       CASE WHEN s.group_key % 3 = 0 THEN s.authority WHEN s.group_key % 3 = 1 THEN '' END AS authority
FROM v_audit_sources a JOIN v_sources s ON a.source_id = s.source_id""",
    "v_uploads": """
SELECT concat('Doc_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING),
              ['.pdf', '.PDF', '.docx', '.xls', '.txt', '.exe', '.tar.gz'][l_linenumber % 7 + 1]) AS name,
       CAST(floor(l_extendedprice) AS BIGINT) * 1000 AS size_bytes,
       CAST(l_quantity AS INT) % 3 AS batch_size
FROM lineitem""",
}

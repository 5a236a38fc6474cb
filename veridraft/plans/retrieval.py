"""Registered queries: retrieval, relevance, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridraft.operators import retrieval as R
from veridraft.operators.verdicts import claim_verdicts
from veridraft.plans.registry import query

C = F.col

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


BM25_SQL = (
    f"""WITH pw AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
        st AS (SELECT avg(len(w)) AS mean_len, count(*) AS n FROM pw),
        post AS (SELECT item_id, term, len, count(*) AS tf FROM (SELECT item_id, len(w) AS len, unnest(w) AS term FROM pw) a GROUP BY item_id, term, len),
        wgt AS (SELECT item_id, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_len)) AS weight FROM post, st),
        terms AS (SELECT term, ln(1 + ((SELECT n FROM st) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post GROUP BY term),
        q AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents),
        sc AS (SELECT q.doc_id, wgt.item_id, round(sum(terms.idf * wgt.weight), 6) AS score
               FROM q JOIN terms ON q.term = terms.term JOIN wgt ON q.term = wgt.term GROUP BY q.doc_id, wgt.item_id)
        SELECT doc_id, item_id, score, CAST(rank AS INT) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM sc) x WHERE rank <= 3"""
)


@query("b06_bm25_top_k", BM25_SQL)
def _(v):
    index = R.build_index(v.table("benchmark"), "item_id")
    return R.bm25_top_k(v.table("documents"), index, 3, "doc_id").select("doc_id", "item_id", "score", "rank")


@query("b06_bm25_two_rounds", BM25_SQL)
def _(v):
    # "rare" means at most five passages here, so that the second round has work to do
    index = R.build_index(v.table("benchmark"), "item_id")
    return R.bm25_top_k(v.table("documents"), index, 3, "doc_id", rare_df=5).select(
        "doc_id", "item_id", "score", "rank"
    )


@query(
    "b07_vector_top_k",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
       q AS (SELECT v AS u FROM e WHERE vec_id = 0)
       SELECT vec_id, round(list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u))), 6) AS similarity
       FROM e, q ORDER BY similarity DESC, vec_id LIMIT 10""",
)
def _(v):
    vectors = v.table("embeddings")
    return R.vector_top_k(vectors, vectors.where("vec_id = 0").select("embedding"), k=10)


@query(
    "b07_vector_top_k_per_label",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
       q AS (SELECT label AS query_id, arg_min(v, vec_id) AS u FROM e GROUP BY label),
       s AS (SELECT query_id, vec_id, round(list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u))), 6) AS score FROM e, q)
       SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) x WHERE rank <= 5""",
)
def _(v):
    vectors = v.table("embeddings")
    # one query per label: its first vector
    queries = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return R.vector_top_k_many(vectors, queries.withColumnRenamed("label", "query_id"), 5)


@query(
    "b09_claim_verdicts",
    """WITH src AS (SELECT concat(CASE WHEN p_size > 5 THEN 'part-' ELSE 'gone-' END, p_partkey) AS source_key, 'AMOUNT' AS kind, CAST(floor(p_retailprice) AS DECIMAL(38, 6)) AS amount, CAST(NULL AS DATE) AS day FROM part
         UNION ALL SELECT concat('order-', o_orderkey), CASE WHEN o_orderstatus = 'P' THEN 'TEXT' ELSE 'DATE' END, NULL, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END FROM orders),
       clm AS (SELECT concat_ws('-', 'A', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id, concat('part-', l_partkey) AS source_key, 'AMOUNT' AS kind,
             CAST(floor(l_extendedprice / l_quantity) AS DECIMAL(38, 6)) AS amount, CAST(NULL AS DATE) AS day FROM lineitem
         UNION ALL SELECT concat_ws('-', 'D', l_orderkey, l_linenumber, l_partkey, l_suppkey), concat('order-', l_orderkey), 'DATE', NULL, CAST(l_shipdate AS DATE) FROM lineitem)
       SELECT c.claim_id, CASE WHEN s.source_key IS NULL THEN 'UNSUPPORTED' WHEN c.kind <> s.kind THEN 'UNCERTAIN'
           WHEN coalesce(c.amount - s.amount, 0) = 0 AND coalesce(date_diff('day', s.day, c.day), 0) = 0 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS verdict,
         CAST(CASE WHEN c.kind = s.kind THEN c.amount - s.amount END AS DOUBLE) AS delta_amount,
         CASE WHEN c.kind = s.kind AND s.amount <> 0 THEN CAST(c.amount - s.amount AS DOUBLE) / CAST(s.amount AS DOUBLE) * 100 END AS delta_percent,
         CAST(CASE WHEN c.kind = s.kind THEN date_diff('day', s.day, c.day) END AS INT) AS delta_days
       FROM clm c LEFT JOIN src s ON c.source_key = s.source_key""",
)
def _(v):
    lines, none = v.table("lineitem"), "CAST(NULL AS DATE) AS day"
    ids = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    amounts = lines.selectExpr(
        f"concat_ws('-', 'A', {ids}) AS claim_id", "concat('part-', l_partkey) AS source_key",
        "'AMOUNT' AS kind", "CAST(floor(l_extendedprice / l_quantity) AS DECIMAL(38, 6)) AS amount", none,
    )
    days = lines.selectExpr(
        f"concat_ws('-', 'D', {ids}) AS claim_id", "concat('order-', l_orderkey) AS source_key",
        "'DATE' AS kind", "CAST(NULL AS DECIMAL(38, 6)) AS amount", "CAST(l_shipdate AS DATE) AS day",
    )
    prices = v.table("part").selectExpr(
        "concat(CASE WHEN p_size > 5 THEN 'part-' ELSE 'gone-' END, p_partkey) AS source_key",
        "'AMOUNT' AS kind", "CAST(floor(p_retailprice) AS DECIMAL(38, 6)) AS amount", none,
    )
    dates = v.table("orders").selectExpr(
        "concat('order-', o_orderkey) AS source_key",
        "CASE WHEN o_orderstatus = 'P' THEN 'TEXT' ELSE 'DATE' END AS kind", "CAST(NULL AS DECIMAL(38, 6)) AS amount",
        "CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day",
    )
    return claim_verdicts(amounts.unionByName(days), prices.unionByName(dates), ["source_key"]).select(
        "claim_id", "verdict", "delta_amount", "delta_percent", "delta_days"
    )

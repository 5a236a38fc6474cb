"""Evidence retrieval: keyword ranking and vector relevance."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridraft.functions.arrays import dot
from veridraft.session import materialise

K1 = 1.2
B = 0.75
#: A term in at most this many passages is "rare": its postings bound what one claim can pair with.
RARE_DF = 1000
#: Passages in a block, and blocks in a block of blocks: 2 to this power.
BLOCK_BITS = 6
BLOCK = 1 << BLOCK_BITS
#: Blocks that a claim without k passages looks into first.
FIRST_BLOCKS = 4
#: Scores are rounded to six digits: bounds get that much room.
SLACK = 1e-6
#: Claims' terms in one task, which holds the passages that they meet.
TASK_TERMS = 50_000
NON_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NON_WORD), lambda w: w != "")


class PassageIndex:
    """Inverted index of the source passages, stored as tables; those for common terms are made
    when a batch of claims first needs them.

    postings(passage key, block, term, df, idf, weight): weight is the saturated,
    length-normalised term frequency; idf * weight is what the term adds to a score. Passages
    of like length share a ``block`` of ``BLOCK`` passages, as their weights are alike.
    terms(term, df, most, idf): ``most`` is the largest weight.
    """

    def __init__(self, key: str, postings: DataFrame, terms: DataFrame, rare_df: int = RARE_DF):
        self.key, self.postings, self.terms, self.rare_df = key, postings, terms, rare_df

    @cached_property
    def rare(self) -> DataFrame:
        return self.postings.where(F.col("df") <= self.rare_df)

    @cached_property
    def common(self) -> DataFrame:
        return self.postings.where(F.col("df") > self.rare_df)

    @cached_property
    def common_terms(self) -> DataFrame:
        return self.terms.where(F.col("df") > self.rare_df).select("term", "idf", "most")

    @cached_property
    def has_common_terms(self) -> bool:
        return not self.common_terms.isEmpty()

    @cached_property
    def weights(self) -> DataFrame:
        """(passage key, _weights): the common words of one passage, as a map."""
        pairs = F.map_from_entries(F.collect_list(F.struct("term", "weight")))
        return materialise(self.common.groupBy(self.key).agg(pairs.alias("_weights")), "passage-weights")

    @cached_property
    def maxima(self) -> list[DataFrame]:
        """(term, cell, parent, most) of common terms: the largest weight in every block of blocks, and in
        every block. A block of blocks has no parent."""
        blocks = materialise(self.common.groupBy("term", F.col("block").alias("cell")).agg(
            F.max("weight").alias("most")
        ).withColumn("parent", F.shiftright("cell", BLOCK_BITS)), "block-maxima")
        above = blocks.groupBy("term", F.col("parent").alias("cell")).agg(F.max("most").alias("most"))
        return [materialise(above.withColumn("parent", F.lit(0).cast("bigint")), "block-maxima"), blocks]


def build_index(
    passages: DataFrame, key: str = "passage_id", text: str = "text", rare_df: int = RARE_DF
) -> PassageIndex:
    """B06. Build the index once; any number of claim batches can use it.

    Corpus totals enter as scalar subqueries, not as a join. The tables are written, since
    every later step reads them several times.
    """
    tokens = passages.select(key, words(F.col(text)).alias("_w")).withColumn("_len", F.size("_w"))
    tokens = tokens.repartitionByRange("_len", key).sortWithinPartitions("_len", key).withColumn(
        "block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    )
    mean_len = passages.agg(F.avg(F.size(words(F.col(text))))).scalar()
    total = passages.agg(F.count(F.lit(1))).scalar()
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("_len") / mean_len)
    counted = (
        tokens.select(key, "block", "_len", F.explode("_w").alias("term"))
        .groupBy(key, "block", "term", "_len")
        .agg(F.count(F.lit(1)).alias("tf"))
        .select(key, "block", "term", (F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm)).alias("weight"))
    )
    counted = materialise(counted, "postings")
    df = F.col("df")
    terms = materialise(
        counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("most"))
        .withColumn("idf", F.log(F.lit(1) + (total - df + 0.5) / (df + 0.5))),
        "terms",
    )
    return PassageIndex(key, materialise(counted.join(terms.drop("most"), "term"), "index"), terms, rare_df)


def bm25_top_k(
    claims: DataFrame,
    index: PassageIndex,
    k: int = 3,
    claim_key: str = "claim_id",
    claim_text: str = "text",
    rare_df: int | None = None,
) -> DataFrame:
    """B06. The k best passages of each claim: exact BM25, ties by passage id.

    Common terms must not pair every claim with every passage, and must not be dropped
    either, so the join runs in two rounds:

    1. candidates share a rare term (at most ``rare_df`` passages per claim term); they are
       scored over *all* their terms, common ones through per-passage maps;
    2. a passage sharing only common terms can still win if those terms together can reach
       the claim's k-th score so far. For claims where they can, see ``surviving_blocks``.

    Without any common term the first round is already complete. ``rare_df`` replaces the
    index's bound for rare terms.
    """
    if rare_df is not None and rare_df != index.rare_df:
        index = PassageIndex(index.key, index.postings, index.terms, rare_df)
    c, p = claim_key, index.key
    query = claims.select(c, F.explode(F.array_distinct(words(F.col(claim_text)))).alias("term"))
    query = by_claim(query.join(index.terms.select("term"), "term", "left_semi"), c)
    pairs = query.join(index.rare, "term")
    rare = pairs.groupBy(c, p).agg(F.sum(F.col("idf") * F.col("weight")).alias("rare_score"))
    if not index.has_common_terms:
        return _best(rare.select(c, p, F.round("rare_score", 6).alias("score")), c, p, k)

    asked = query.join(index.common_terms, "term")
    # bounded by the words of one claim
    claim_common = asked.groupBy(c).agg(F.collect_list(F.struct("term", "idf")).alias("_terms"))
    extra = F.aggregate(
        F.coalesce("_terms", F.array().cast("array<struct<term:string,idf:double>>")),
        F.lit(0.0).cast("double"),
        lambda acc, t: acc + t["idf"] * F.coalesce(F.col("_weights")[t["term"]], F.lit(0.0)),
    )
    scored = rare.join(claim_common, c, "left").join(index.weights, p, "left").select(
        c, p, F.round(F.col("rare_score") + extra, 6).alias("score")
    )
    first = materialise(_best(scored, c, p, k), "first-round").select(c, p, "score")
    first, blocks = surviving_blocks(asked, index, first, c, k)
    if blocks is not None:
        # A passage with a rare term gets less here than in the first round, where all of those were scored.
        # So the k best of either are enough.
        more = _best(common_scores(asked, index, blocks, c), c, p, k).drop("rank")
        first = first.unionByName(more).groupBy(c, p).agg(F.max("score").alias("score"))
    return _best(first, c, p, k)


def by_claim(query: DataFrame, c: str) -> DataFrame:
    """query(claim, term), written once and dealt by claim to as many tasks as its rows need."""
    query = materialise(query.select(c, "term"), "claim-terms")
    tasks = int(query.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return query.repartition(max(tasks, -(-query.count() // TASK_TERMS)), c)


def common_scores(asked: DataFrame, index: PassageIndex, blocks: DataFrame, c: str) -> DataFrame:
    """(claim, passage, score) of the passages in blocks(claim, cell), over common terms."""
    met = asked.select(c, "term").join(blocks.select(c, F.col("cell").alias("block")), c)
    return met.join(index.common, ["term", "block"]).groupBy(c, index.key).agg(
        F.round(F.sum(F.col("idf") * F.col("weight")), 6).alias("score")
    )


def surviving_blocks(
    asked: DataFrame, index: PassageIndex, first: DataFrame, c: str, k: int
) -> tuple[DataFrame, DataFrame | None]:
    """Where passages that share only common terms with a claim can still be among its k best.

    asked(claim, term, idf, most) has the claims' common terms, first(claim, passage, score) the
    best so far. Returns ``first``, maybe with more passages, and blocks(claim, cell).

    The largest weight of a term in a block of passages bounds what any passage of the block can
    get from it. A claim meets blocks of blocks, then the blocks in those whose bound reaches its
    k-th score, then the passages of such blocks. Claims without k passages so far first look
    into the ``FIRST_BLOCKS`` blocks with the highest bounds, which gives them a k-th score.
    """
    p = index.key
    kth = first.groupBy(c).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth"))
    reach = asked.groupBy(c).agg(F.sum(F.col("idf") * F.col("most")).alias("_reach")).join(kth, c, "left")
    open_ = materialise(
        reach.where((F.coalesce("_n", F.lit(0)) < k) | (F.col("_reach") >= F.col("_kth") - SLACK))
        .select(c, F.when(F.col("_n") >= k, F.col("_kth")).alias("_kth")),
        "open-claims",
    )
    if open_.isEmpty():
        return first, None

    def cells(level: int, claims: DataFrame, inside: DataFrame | None = None) -> DataFrame:
        """(claim, cell, bound, _kth) of the cells of a level, inside given ones of the level above."""
        met = asked.drop("most").join(claims, c).join(index.maxima[level], "term")
        if inside is not None:
            met = met.join(inside.select(c, F.col("cell").alias("parent")), [c, "parent"], "left_semi")
        bound = met.groupBy(c, "cell").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"), F.first("_kth").alias("_kth"))
        return bound.where(F.col("_kth").isNull() | (F.col("bound") >= F.col("_kth") - SLACK))

    unsure = open_.where("_kth IS NULL")
    if not unsure.isEmpty():
        highest = F.row_number().over(Window.partitionBy(c).orderBy(F.desc("bound"), "cell"))
        above = cells(0, unsure).withColumn("_r", highest).where(F.col("_r") <= FIRST_BLOCKS)
        blocks = cells(1, unsure, above).withColumn("_r", highest).where(F.col("_r") <= FIRST_BLOCKS)
        more = _best(common_scores(asked, index, blocks, c), c, p, k).drop("rank")
        first = first.unionByName(more).groupBy(c, p).agg(F.max("score").alias("score"))
        first = materialise(_best(first, c, p, k).drop("rank"), "first-blocks")
        kth = first.groupBy(c).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth"))
        open_ = open_.select(c).join(kth, c, "left").select(c, F.when(F.col("_n") >= k, F.col("_kth")).alias("_kth"))
    return first, cells(1, open_, cells(0, open_))


def _best(pairs: DataFrame, c: str, p: str, k: int) -> DataFrame:
    """Top k per claim; the rank limit is also applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(c).orderBy(F.desc("score"), F.col(p)))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_top_k(
    vectors: DataFrame, query: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """B07. The k vectors most similar (cosine) to one query vector.

    query: one row, one array column. It enters as a scalar subquery; every vector is scored
    where it is read and only k rows per task reach the final sort.
    """
    q = query.scalar()
    v, u = F.col(vector), F.col("_q")
    norms = F.sqrt(dot(v, v)) * F.sqrt(dot(u, u))
    cosine = F.when(norms == 0, 0.0).otherwise(dot(v, u) / norms)
    scored = vectors.withColumn("_q", q).select(key, F.round(cosine, 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), F.col(key)).limit(k)


#: Vectors that groups are formed around, vectors in a ring of a group, queries in a block.
PIVOTS, RING, QUERY_BLOCK = 64, 2048, 512
#: Similarities are rounded to six digits: bounds get that much room.
ROOM = 2e-6


def vector_top_k_many(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    query_key: str = "query_id",
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """B07. The k most similar vectors for each query of queries(query_key, vector).

    Exact, and nothing passes through the driver. Directions are grouped round ``PIVOTS`` of
    them, each group is sorted by distance to its pivot and cut into rings of ``RING`` vectors, one
    row each; queries come in blocks, one row each. Every block of queries meets every ring, as
    rows of a join. By the triangle inequality a ring can hold nothing nearer to a query than the
    difference between the query's distance to the pivot and the ring's; rings that are too far
    away for a query are skipped, the others are compared as one matrix product. The pivots give each
    query a first bound.

    Vectors that are null or hold a null take no part; a zero vector is similar to nothing.
    """
    some = vectors.where(F.col(vector).isNotNull() & ~F.exists(vector, F.isnull)).select(key, vector)
    asked = queries.where(F.col(vector).isNotNull() & ~F.exists(vector, F.isnull)).select(query_key, vector)
    first = F.collect_list(F.col(vector).cast("array<double>"))
    pivots = some.orderBy(F.xxhash64(key), key).limit(PIVOTS).agg(first.alias("p")).scalar()
    names = {"key": vectors.schema[key].dataType, "query": queries.schema[query_key].dataType}

    rings = materialise(_rings(some, pivots, key, vector, names["key"]), "vector-rings")
    blocks = materialise(_query_blocks(asked, pivots, query_key, vector, k, block, names["query"]), "query-blocks")
    # Rings are dealt to groups, and every query block goes to each group.
    groups = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    rings = rings.withColumn("_group", F.pmod(F.xxhash64("ring"), F.lit(groups)))
    met = blocks.hint("merge").join(rings, "_group").drop("_group")
    schema = T.StructType([
        T.StructField(query_key, names["query"]), T.StructField(key, names["key"]), T.StructField("score", T.DoubleType()),
    ])
    return _best(met.mapInArrow(_compared(k, query_key, key), schema), query_key, key, k)


def _unit_rows(rows) -> np.ndarray:
    """Rows scaled to length 1; a zero vector stays zero."""
    matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in rows])
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norms == 0, 1.0, norms)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between directions."""
    return np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))


def ring_bounds(queries: np.ndarray, pivot: np.ndarray, near: float, far: float) -> np.ndarray:
    """The largest similarity that each query can have with a vector at a distance from ``near`` to ``far``
    of the pivot. A ring of zero vectors has a negative distance and no bound, nor has a zero query."""
    at = distances(queries, pivot[None])[:, 0]
    apart = np.maximum(0, np.maximum(at - far, near - at) - 1e-9)
    unbound = (near < 0) | ~queries.any(axis=1)
    return np.where(unbound, 1.0, 1 - apart * apart / 2) + ROOM


def _now_and_then(pivots: Column) -> Column:
    """The pivots in the first row of a partition and in few others: a task keeps them."""
    return F.when(F.monotonically_increasing_id().bitwiseAND(F.lit(4095)) == 0, pivots)


def _seen(column: pa.Array, held: np.ndarray | None) -> np.ndarray | None:
    """The pivots' directions, from the first row that has them."""
    if held is None:
        column = column.drop_null()
        return _unit_rows(column[0].as_py()) if len(column) else None
    return held


def _arrow(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def _rings(vectors: DataFrame, pivots: Column, key: str, vector: str, kind: T.DataType) -> DataFrame:
    """(ring, pivot, near, far, keys, unit): up to ``RING`` vectors at like distances of a pivot."""

    def placed(batches):
        centres = None
        for batch in batches:
            if not batch.num_rows:
                continue
            centres = _seen(batch.column(2), centres)
            unit = _unit_rows(batch.column(1).to_pylist())
            away = distances(unit, centres)
            pivot = away.argmin(axis=1)
            zero = ~unit.any(axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), _arrow([u.tobytes() for u in unit], pa.binary()),
                _arrow(np.where(zero, -1, pivot), pa.int32()),
                _arrow(np.where(zero, -1.0, away[np.arange(len(unit)), pivot]), pa.float64()),
            ], [key, "unit", "pivot", "away"])

    fields = [(key, kind), ("unit", T.BinaryType()), ("pivot", T.IntegerType()), ("away", T.DoubleType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    order = ["pivot", "away", key]
    near = vectors.select(key, vector, _now_and_then(pivots).alias("_pivots")).mapInArrow(placed, schema)
    near = near.repartitionByRange(*order).sortWithinPartitions(*order).select("*", _now_and_then(pivots).alias("_pivots"))

    def cut(batches):
        part, ring = TaskContext.get().partitionId(), 0
        held, pivot, units = [], None, None

        def row():
            nonlocal ring
            ring += 1
            centre = units[max(pivot, 0)].tobytes()
            return pa.RecordBatch.from_arrays([
                _arrow([(ring << 20) + part], pa.int64()), _arrow([centre], pa.binary()),
                _arrow([held[0][2]], pa.float64()), _arrow([held[-1][2]], pa.float64()),
                _arrow([[h[0] for h in held]], pa.list_(key_type)), _arrow([b"".join(h[1] for h in held)], pa.binary()),
            ], ["ring", "pivot", "near", "far", "keys", "units"])

        for batch in batches:
            key_type = batch.schema.field(0).type
            units = _seen(batch.column(4), units)
            for k, u, p, away in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (p != pivot or len(held) == RING):
                    yield row()
                    held = []
                pivot = p
                held.append((k, u, away))
        if held:
            yield row()

    double = T.DoubleType()
    fields = [("ring", T.LongType()), ("pivot", T.BinaryType()), ("near", double), ("far", double)]
    fields += [("keys", T.ArrayType(kind)), ("units", T.BinaryType())]
    return near.mapInArrow(cut, T.StructType([T.StructField(n, t) for n, t in fields]))


def _query_blocks(
    queries: DataFrame, pivots: Column, query_key: str, vector: str, k: int, block: int, kind: T.DataType
) -> DataFrame:
    """(block, queries, asked, floor): directions of up to ``block`` queries, and the k-th best similarity that
    the pivots have with each."""

    def run(batches):
        part, number, centres = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            centres = _seen(batch.column(2), centres)
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                unit = _unit_rows(some.column(1).to_pylist())
                floor = np.full(len(unit), -2.0)
                if centres is not None and len(centres) >= k:
                    floor = -np.sort(-np.round(unit @ centres.T, 6), axis=1)[:, k - 1]
                number += 1
                yield pa.RecordBatch.from_arrays([
                    _arrow([(number << 20) + part], pa.int64()),
                    _arrow([some.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)),
                    _arrow([unit.tobytes()], pa.binary()), _arrow([floor.tobytes()], pa.binary()),
                ], ["block", "queries", "asked", "floor"])

    fields = [("block", T.LongType()), ("queries", T.ArrayType(kind)), ("asked", T.BinaryType()), ("floor", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    return queries.select(query_key, vector, _now_and_then(pivots).alias("_pivots")).mapInArrow(run, schema)


def _compared(k: int, query_key: str, key: str):
    """The k best of each query, ring after ring; a query block's rows come together."""

    def run(batches):
        at = None

        def out():
            rows = [(q, v, s) for q, best in zip(names, kept) for s, v in best]
            kinds = [query_type.value_type, key_type.value_type, pa.float64()]
            return pa.RecordBatch.from_arrays(
                [_arrow([r[i] for r in rows], t) for i, t in enumerate(kinds)], [query_key, key, "score"]
            )

        for batch in batches:
            query_type, key_type = (batch.schema.field(batch.schema.get_field_index(n)).type for n in ("queries", "keys"))
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] != at:
                    if at is not None:
                        yield out()
                    at, names = row["block"], row["queries"]
                    asked = np.frombuffer(row["asked"]).reshape(len(names), -1)
                    floor = np.frombuffer(row["floor"]).copy()
                    kept = [[] for _ in names]
                keys, pivot = row["keys"], np.frombuffer(row["pivot"])
                needed = np.flatnonzero(ring_bounds(asked, pivot, row["near"], row["far"]) >= floor)
                if not len(needed):
                    continue
                scores = np.round(asked[needed] @ np.frombuffer(row["units"]).reshape(len(keys), -1).T, 6)
                for q, line in zip(needed.tolist(), scores):
                    found = np.flatnonzero(line >= floor[q])
                    if len(found):
                        best = kept[q] + [(float(line[j]), keys[j]) for j in found.tolist()]
                        best.sort(key=lambda b: (-b[0], b[1]))
                        kept[q] = best[:k]
                        if len(best) >= k:
                            floor[q] = max(floor[q], kept[q][-1][0])
        if at is not None:
            yield out()

    return run

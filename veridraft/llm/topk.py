"""Exact top-k by inner product: rows in buckets of like length, each pruned in its own way.

A score is |q| |r| cos(q, r). Rows are sorted by length, longest first, and cut into buckets. A
query that already has k scores of at least t needs from a bucket whose longest row has length l
only rows with a cosine of at least t / (|q| l), its local threshold there:

* above 1 the bucket goes, for the query or, before the data move, for the whole query block;
* from ``COORDINATES_FROM`` on, the query's largest coordinates bound the same coordinate of any
  such row; the sorted coordinates of the bucket give the candidates (coordinate pruning);
* below that, rows shorter than t / |q| go (length pruning).

What is left is verified with whole-number products. The first thresholds come from the
longest rows, which every query meets first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veridraft.llm.common import map_batches, table
from veridraft.llm.vectors import (
    BLOCK_FIELDS, NONE, QUERIES, ROOM, ROWS, Best, Block, blocks, grid, lengths, pair_rows, products, whole_vectors,
)
from veridraft.session import materialise

SCALE, K = 64, 20
#: Longest rows that give the first thresholds: one block, sent to all tasks as a scalar subquery.
SEED_ROWS = 256
#: Local threshold from which coordinates prune more than they cost, and the coordinates looked at.
COORDINATES_FROM, FOCUS = 0.8, 4

PARTIAL_FIELDS = [
    ("part", T.IntegerType()), ("seq", T.IntegerType()), ("slot", T.IntegerType()),
    ("query_id", T.LongType()), ("vec_id", T.LongType()), ("score", T.LongType()),
]


class Bucket(Block):
    """Rows of like length in a task, longest first; directions and their order are made when needed."""

    def prepare(self) -> Bucket:
        self.length = lengths(self.mat)
        self.longest = float(self.length.max(initial=0))
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        return self

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, values) of one coordinate of the rows' directions."""
        if f not in self.sorted:
            values = self.mat[:, f] / np.maximum(self.length, 1)
            order = np.argsort(values, kind="stable")
            self.sorted[f] = order, values
        return self.sorted[f]

    def within(self, direction: np.ndarray, local: float) -> np.ndarray:
        """Rows that may have a cosine of at least ``local`` with a unit vector."""
        focus = [f for f in np.argsort(-np.abs(direction))[:FOCUS] if f < self.mat.shape[1]]
        left = None
        for f in focus:
            order, values = self.coordinate(f)
            middle = direction[f] * local
            reach = np.sqrt(max(0.0, 1 - local * local) * max(0.0, 1 - direction[f] ** 2)) + 1e-9
            if left is None:
                first = np.searchsorted(values, middle - reach, "left", order)
                left = order[first : np.searchsorted(values, middle + reach, "right", order)]
            else:
                left = left[np.abs(values[left] - middle) <= reach]
        return np.arange(len(self.ids)) if left is None else left


def meet(queries: Block, length: np.ndarray, bucket: Bucket, best: Best, own: bool = False) -> dict[str, int]:
    """Add what a bucket has for a block of queries; returns how many products each way has cost.

    ``own``: rows with the query's own id count as well.
    """
    spent = {"length": 0, "coordinates": 0}
    least = best.least().astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(least > 0, least / (length * bucket.longest * ROOM), -1.0)
    local[(least > 0) & (length * bucket.longest == 0)] = np.inf
    bound = float(length.max(initial=0)) * bucket.longest * ROOM

    def verify(rows: np.ndarray, which: np.ndarray, scores: np.ndarray) -> None:
        ids = bucket.ids[which]
        keep = best.enters(rows, ids, scores)
        if not own:
            keep &= ids != queries.ids[rows]
        best.add(rows[keep], ids[keep], scores[keep])

    near = (local >= COORDINATES_FROM) & (local <= 1)
    for q in np.flatnonzero(near):
        left = bucket.within(queries.mat[q] / length[q], float(local[q]))
        spent["coordinates"] += len(left)
        scores = products(queries.mat[q : q + 1], bucket.mat[left], bound)[0]
        verify(np.full(len(left), q), left, scores)

    far = np.flatnonzero(local < COORDINATES_FROM)
    if len(far):
        shortest = np.where(least[far] > 0, least[far] / np.maximum(length[far], 1e-300) / ROOM, 0).min()
        reach = int(np.searchsorted(-bucket.length, -shortest, "right"))
        spent["length"] += len(far) * reach
        scores = products(queries.mat[far], bucket.mat[:reach], bound)
        row, which = np.nonzero(scores >= best.least()[far][:, None])
        verify(far[row], which, scores[row, which])
    return spent


def _seeded(k: int, own: bool):
    """The k-th score among the longest rows, for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pair_rows(batches):
            queries, best = Block.read(row, "q_"), Best(row["q_n"], k)
            if row["r_seed"] is not None:
                meet(queries, lengths(queries.mat), Bucket.read(row["r_seed"], "").prepare(), best, own)
            floor = best.scores[:, -1]
            values = [row[f"q_{n}"] for n, _ in BLOCK_FIELDS] + [floor.tobytes(), float(floor.min())]
            kinds = [pa.int32()] * 4 + [pa.float64()] + [pa.binary()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(values, kinds)], [n for n, _ in BLOCK_FIELDS] + ["floor", "least"]
            )

    return run


def _searched(k: int, own: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = queries = best = length = None

        def out():
            row, place = best.found()
            n = len(row)
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(n, at[0], np.int32)), pa.array(np.full(n, at[1], np.int32)),
                pa.array(row.astype(np.int32)), pa.array(queries.ids[row]),
                pa.array(best.ids[row, place]), pa.array(best.scores[row, place]),
            ], [n for n, _ in PARTIAL_FIELDS])

        for pair in pair_rows(batches):
            if (pair["q_part"], pair["q_seq"]) != at:
                if at:
                    yield out()
                at, queries = (pair["q_part"], pair["q_seq"]), Block.read(pair, "q_")
                best = Best(len(queries.ids), k, np.frombuffer(pair["q_floor"], np.int64))
                length = lengths(queries.mat)
            meet(queries, length, Bucket.read(pair, "r_").prepare(), best, own)
        if at:
            yield out()

    return run


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int = K, scale: int = SCALE, own: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) of (id, vector) queries and rows: each query's k best inner products.

    Components become floor(scale * x). Higher scores come first, ties by smaller vec_id. Rows
    with the query's own id take no part unless ``own`` is set; fewer than k others: all of them.

    Rows without an id take no part, as they can't be named; vectors that are null or hold a null
    or non-finite component neither. A repeated row is a row of its own, as query and as
    candidate. Of vectors of unlike sizes the shorter one ends in zeros; an empty vector scores 0.
    Components beyond 2^31 / sqrt(size) count as that bound, so a score always fits a long.
    Columns besides id and vector are not read; no rows give no rows.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 24))
    nothing = F.lit(None).cast("long").alias("label")
    order = [F.desc("length"), F.asc("id")]
    vectors = materialise(whole_vectors(rows.select("id", nothing, "vector"), scale), "topk-vectors")
    buckets = materialise(
        blocks(vectors.repartitionByRange(*order).sortWithinPartitions(*order), ROWS), "topk-buckets"
    )
    asked = whole_vectors(queries.select("id", nothing, "vector"), scale)
    asked = blocks(asked.repartitionByRange(*order).sortWithinPartitions(*order), QUERIES)

    seed = blocks(vectors.orderBy(*order).limit(SEED_ROWS), SEED_ROWS).where("seq = 0")
    seed = seed.select(F.struct(*seed.columns)).scalar()
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns)).withColumn("r_seed", seed)
    fields = BLOCK_FIELDS + [("floor", T.BinaryType()), ("least", T.DoubleType())]
    asked = map_batches(asked, _seeded(k, own), fields)
    asked = materialise(asked, "topk-queries")

    needed = (F.col("q_least") <= 0) | (F.col("q_longest") * F.col("r_longest") * ROOM >= F.col("q_least"))
    partial = map_batches(grid(asked, buckets, needed), _searched(k, own), PARTIAL_FIELDS)
    best = Window.partitionBy("part", "seq", "slot").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_top_k_search(spark, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return exact_top_k(rows.where("id % 20 = 0"), rows)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""

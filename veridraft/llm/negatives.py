"""Hard negatives by window search in packed R-trees.

Rows are packed by sort, tile, recurse: sorted by label and the coordinate that varies most, cut
into slabs of ``SLAB`` rows; a slab is sorted by its own widest coordinate and cut into strips, a
strip by its widest into leaves of ``LEAF`` rows. Each slab is one tree (slab, strips, leaves)
and one row of a table. Every node has a box: the least and the largest value of each coordinate.

For a query vector q each coordinate of a box gives an interval of q_i r_i, and their sums
bound all products below the node. A best-first queue over the nodes takes the one with the
largest upper bound; for each query a node goes if its interval misses the query's score window,
if its upper bound lies strictly below the k-th score found, or if its labels can't serve.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veridraft.llm.common import map_batches, table
from veridraft.llm.vectors import (
    BLOCK_FIELDS, NONE, QUERIES, ROOM, VECTOR_FIELDS, Best, Block, block_row, gathered, grid, lengths, matrix,
    pair_rows, products, whole_vectors,
)
from veridraft.session import materialise

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative scores between LOW / OF and HIGH / OF of the positive's score.
LOW, HIGH, OF = 80, 100, 100
SLAB, LEAF = 4096, 128
TOP = 1 << 62

_LABELS = [("first_label", T.LongType()), ("last_label", T.LongType())]
TREE_FIELDS = BLOCK_FIELDS + _LABELS + [(n, T.BinaryType()) for n in ("leaves", "strips", "low", "high")]
ASKED = [("uid", T.LongType()), ("place", T.IntegerType()), ("mark", T.LongType()), ("floor", T.LongType()), ("roof", T.LongType())]
QUERY_FIELDS = BLOCK_FIELDS + _LABELS + [("least", T.DoubleType())] + [(n, T.BinaryType()) for n, _ in ASKED]
FOUND_FIELDS = [
    ("uid", T.LongType()), ("place", T.IntegerType()), ("query_id", T.LongType()), ("mark", T.LongType()),
    ("roof", T.LongType()), ("vec_id", T.LongType()), ("score", T.LongType()),
]


# Packing


def _spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums, squares = np.zeros(0), np.zeros(0), np.zeros(0)
    for batch in batches:
        mat = matrix(batch.column(0).to_pylist()).astype(np.float64) if batch.num_rows else np.zeros((0, 0))
        if mat.shape[1] > len(n):
            n, sums, squares = (np.pad(x, (0, mat.shape[1] - len(x))) for x in (n, sums, squares))
        n[: mat.shape[1]] += len(mat)
        sums[: mat.shape[1]] += mat.sum(0)
        squares[: mat.shape[1]] += (mat * mat).sum(0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(sums), pa.array(squares)],
        ["axis", "n", "sum", "squares"],
    )


def widest_axis(vectors: DataFrame) -> int:
    """The coordinate with the largest variance over all rows: one row per coordinate is compared."""
    double = T.DoubleType()
    found = map_batches(
        vectors.select("vec"), _spreads, [("axis", T.IntegerType()), ("n", double), ("sum", double), ("squares", double)]
    ).groupBy("axis").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"))
    spread = F.col("squares") / F.col("n") - (F.col("sum") / F.col("n")) ** 2
    first = found.orderBy(F.desc(spread), "axis").first()
    return first.axis if first else 0


def _keyed(axis: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = axis * 4
        for batch in batches:
            key = [int.from_bytes(x[at : at + 4], "little", signed=True) for x in batch.column(2).to_pylist()]
            yield batch.append_column("key", pa.array(key, pa.int64()))

    return run


def pack(mat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first row of each leaf, first leaf of each strip) of a slab."""
    n = len(mat)
    leaves = -(-n // LEAF)
    per_strip = -(-leaves // max(1, round(leaves**0.5))) * LEAF
    order, starts, strips = _by_widest(mat, np.arange(n)), [], []
    for at in range(0, n, per_strip):
        order[at : at + per_strip] = _by_widest(mat, order[at : at + per_strip])
        strips.append(len(starts))
        starts += range(at, min(at + per_strip, n), LEAF)
    return order, np.array(starts, np.int32), np.array(strips, np.int32)


def _by_widest(mat: np.ndarray, rows: np.ndarray) -> np.ndarray:
    part = mat[rows]
    if not part.shape[1]:
        return rows
    return rows[np.argsort(part[:, part.var(0).argmax()], kind="stable")]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for seq, (ids, labels, mat) in enumerate(gathered(batches, SLAB)):
        order, starts, strips = pack(mat)
        ids, labels, mat = ids[order], labels[order], mat[order]
        low, high = np.minimum.reduceat(mat, starts), np.maximum.reduceat(mat, starts)
        row = block_row(part, seq, mat, ids, labels)
        more = [pa.array([int(labels.min())]), pa.array([int(labels.max())])]
        more += [pa.array([x.tobytes()], pa.binary()) for x in (starts, strips, low, high)]
        yield pa.RecordBatch.from_arrays(row.columns + more, [n for n, _ in TREE_FIELDS])


def trees(vectors: DataFrame) -> DataFrame:
    """One row per slab of (id, label, vec)."""
    keyed = map_batches(
        vectors.select(*(n for n, _ in VECTOR_FIELDS)), _keyed(widest_axis(vectors)), VECTOR_FIELDS + [("key", T.LongType())]
    )
    order = ["label", "key", "id"]
    return map_batches(keyed.repartitionByRange(*order).sortWithinPartitions(*order), _trees, TREE_FIELDS)


# Searching


class Tree(Block):
    """A slab's tree in a task: node 0 is the slab, then its strips, then its leaves."""

    def open(self, row: dict) -> Tree:
        dim = self.mat.shape[1]
        starts, strips = np.frombuffer(row["r_leaves"], np.int32), np.frombuffer(row["r_strips"], np.int32)
        low, high = (np.frombuffer(row[f"r_{x}"], np.int32).reshape(len(starts), dim) for x in ("low", "high"))
        self.ends = np.r_[starts, len(self.ids)]
        self.first_leaf = 1 + len(strips)
        ends = np.r_[strips, len(starts)] + self.first_leaf
        self.children = [range(1, self.first_leaf)] + [range(a, b) for a, b in zip(ends, ends[1:])]
        strip_low, strip_high = np.minimum.reduceat(low, strips), np.maximum.reduceat(high, strips)
        self.low = np.vstack([low.min(0, keepdims=True), strip_low, low]).astype(np.float64)
        self.high = np.vstack([high.max(0, keepdims=True), strip_high, high]).astype(np.float64)
        first, last = np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)
        self.first = np.r_[first.min(), np.minimum.reduceat(first, strips), first]
        self.last = np.r_[last.max(), np.maximum.reduceat(last, strips), last]
        return self

    def leaf(self, node: int) -> slice:
        return slice(self.ends[node - self.first_leaf], self.ends[node - self.first_leaf + 1])


class Asked(Block):
    """A block of queries in a task. Neighbours with the same vector share their products."""

    def open(self, row: dict, k: int) -> Asked:
        self.uid, self.mark, self.floor, self.roof = (
            np.frombuffer(row[f"q_{n}"], np.int64) for n in ("uid", "mark", "floor", "roof")
        )
        self.place = np.frombuffer(row["q_place"], np.int32)
        new = np.r_[True, (self.mat[1:] != self.mat[:-1]).any(1)]
        self.vector, self.of = self.mat[new], np.cumsum(new) - 1
        self.longest = float(lengths(self.vector).max(initial=0))
        whole = self.vector.astype(np.float64)
        self.above, self.below = np.maximum(whole, 0), np.minimum(whole, 0)
        self.best = Best(len(self.ids), k, self.floor)
        return self

    def intervals(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(smallest, largest) product of each query with anything in each box."""
        dim = min(self.above.shape[1], low.shape[1])
        above, below, low, high = self.above[:, :dim], self.below[:, :dim], low[:, :dim], high[:, :dim]
        most = float(((above - below) @ np.maximum(abs(low), abs(high)).T).max(initial=0))
        slack = 0.0 if most < 1 << 52 else most * 1e-9
        least, largest = above @ low.T + below @ high.T - slack, above @ high.T + below @ low.T + slack
        return least[self.of], largest[self.of]


def visit(asked: Asked, tree: Tree, same: bool) -> int:
    """Best-first through one tree for a block of queries; returns the leaves opened."""
    best, opened, number = asked.best, 0, 0
    bound = asked.longest * float(lengths(tree.mat).max(initial=0)) * ROOM
    queue: list[tuple] = []

    def offer(nodes, rows: np.ndarray) -> None:
        nonlocal number
        nodes = np.asarray(nodes)
        least, largest = asked.intervals(tree.low[nodes], tree.high[nodes])
        label = asked.labels[rows, None]
        fits = (tree.first[nodes] <= label) & (label <= tree.last[nodes])
        if not same:
            fits = ~fits | (tree.first[nodes] != tree.last[nodes])
        fits &= (least[rows] <= asked.roof[rows, None]) & (largest[rows] >= best.least()[rows, None])
        for i, node in enumerate(nodes):
            left = rows[fits[:, i]]
            if len(left):
                number += 1
                upper = largest[left, i]
                heapq.heappush(queue, (-upper.max(), number, int(node), left, upper))

    offer([0], np.arange(len(asked.ids)))
    while queue:
        _, _, node, rows, upper = heapq.heappop(queue)
        rows = rows[upper >= best.least()[rows]]
        if not len(rows):
            continue
        if node < tree.first_leaf:
            offer(tree.children[node], rows)
            continue
        opened += 1
        leaf = tree.leaf(node)
        used, back = np.unique(asked.of[rows], return_inverse=True)
        scores = products(asked.vector[used], tree.mat[leaf], bound)[back]
        equal = asked.labels[rows, None] == tree.labels[leaf]
        good = (scores <= asked.roof[rows, None]) & (scores >= best.least()[rows, None]) & (equal == same)
        row, which = np.nonzero(good)
        row, ids, scores = rows[row], tree.ids[leaf][which], scores[row, which]
        keep = best.enters(row, ids, scores) & (ids != asked.ids[row])
        best.add(row[keep], ids[keep], scores[keep])
    return opened


def _searched(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = asked = None

        def out():
            row, place = asked.best.found()
            values = (
                asked.uid[row], asked.place[row], asked.ids[row], asked.mark[row], asked.roof[row],
                asked.best.ids[row, place], asked.best.scores[row, place],
            )
            return pa.RecordBatch.from_arrays([pa.array(x) for x in values], [n for n, _ in FOUND_FIELDS])

        for pair in pair_rows(batches):
            if (pair["q_part"], pair["q_seq"]) != at:
                if at:
                    yield out()
                at, asked = (pair["q_part"], pair["q_seq"]), Asked.read(pair, "q_").open(pair, k)
            visit(asked, Tree.read(pair, "r_").open(pair), same)
        if at:
            yield out()

    return run


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        most = max(1, min(QUERIES, (1 << 22) // max(1, max(map(len, batch.column(2).to_pylist()), default=1))))
        for at in range(0, batch.num_rows, most):
            some = batch.slice(at, most)
            ids, labels = (some.column(k).to_numpy() for k in (0, 1))
            row = block_row(part, seq, matrix(some.column(2).to_pylist()), ids, labels)
            asked = [some.column(k).to_numpy() for k in range(3, 3 + len(ASKED))]
            more = [pa.array([int(labels.min())]), pa.array([int(labels.max())]), pa.array([float(asked[3].min())])]
            more += [pa.array([x.tobytes()], pa.binary()) for x in asked]
            yield pa.RecordBatch.from_arrays(row.columns + more, [n for n, _ in QUERY_FIELDS])
            seq += 1


def window_search(queries: DataFrame, packed: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best rows of each query (uid, place) with a score from floor to roof, of its label or of others."""
    order = ["label", "uid", "place"]
    columns = ["id", "label", "vec", *(n for n, _ in ASKED)]
    asked = queries.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    asked = map_batches(asked, _query_blocks, QUERY_FIELDS)
    needed = (F.col("q_least") <= 0) | (F.col("q_longest") * F.col("r_longest") * ROOM >= F.col("q_least"))
    if same:
        needed &= (F.col("q_first_label") <= F.col("r_last_label")) & (F.col("q_last_label") >= F.col("r_first_label"))
    found = map_batches(grid(asked, packed, needed), _searched(k, same), FOUND_FIELDS)
    best = Window.partitionBy("uid", "place").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    anchors: DataFrame, rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, of: int = OF, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (id, label, vector) tables.

    Scores are inner products of floor(scale * x), higher ones first, ties by smaller id. An
    anchor's positives are its first rows of the same label; each pair gets the first rows of
    other labels with low * positive <= of * negative <= high * positive (high at most ``of``).
    A pair without such rows, as one with a negative score, has no row in the result.

    Rows without an id or a label take no part, nor do vectors that are null or hold a null or
    non-finite component. A row with the anchor's id is never its positive. A repeated row is a
    row of its own, as anchor, positive and negative. Shorter vectors end in zeros; components
    beyond 2^31 / sqrt(size) count as that bound. Other columns are not read; no rows, no result.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 24))
    columns = ["id", "label", "vector"]
    vectors = materialise(whole_vectors(rows.select(*columns).where("label IS NOT NULL"), scale), "negatives-vectors")
    packed = materialise(trees(vectors), "negatives-trees")
    asked = whole_vectors(anchors.select(*columns).where("label IS NOT NULL"), scale)
    asked = materialise(asked.withColumn("uid", F.monotonically_increasing_id()), "negatives-anchors")

    long, none = (lambda x: F.lit(x).cast("long")), F.lit(0).cast("int").alias("place")
    first = asked.select("*", none, long(0).alias("mark"), long(NONE).alias("floor"), long(TOP).alias("roof"))
    found = window_search(first, packed, positives, same=True)
    pairs = found.select("uid", F.col("rank").alias("place"), F.col("vec_id").alias("mark"), F.col("score").alias("positive"))
    pairs = pairs.where("positive >= 0").withColumns({
        "floor": F.expr(f"({low} * positive + {of - 1}) div {of}"), "roof": F.expr(f"({high} * positive) div {of}"),
    })
    pairs = materialise(pairs.join(asked, "uid"), "negatives-pairs")
    score = pairs.select("uid", "place", "positive")
    return window_search(pairs, packed, negatives, same=False).join(score, ["uid", "place"]).select(
        F.col("query_id").alias("anchor_id"), F.col("mark").alias("positive_id"), "rank",
        F.col("vec_id").alias("negative_id"), F.col("positive").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label")).alias("label"),
        F.col("embedding").alias("vector"),
    )
    return hard_negatives(rows.where("id % 100 = 0"), rows)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id,
  positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

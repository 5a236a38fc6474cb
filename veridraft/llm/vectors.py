"""Blocks of whole-number vectors, and the work that the two vector searches share.

A vector becomes ``floor(scale * x)`` per component and is kept as bytes; many vectors in a
chosen order make one row, a block, with their ids. Blocks of queries meet blocks of rows in a
grid: rows are dealt to ``spread`` groups, every query block goes to each group. So nothing but
blocks is ever repeated, and a task holds one query block and one block of rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridraft.llm.common import map_batches

#: Vectors in a block of rows, in a block of queries, and the most bytes in a block.
ROWS, QUERIES, BYTES = 2048, 512, 1 << 22
#: Blocks of rows that a group of the grid gets, and the most groups (queries are sent to each).
PER_GROUP, MOST_GROUPS = 8, 4096
#: Stands for "no score"; scores of vectors stay far above.
NONE = -(1 << 63) + 1
#: Products of lengths are doubles: bounds get this much room.
ROOM = 1 + 1e-9

VECTOR_FIELDS = [("id", T.LongType()), ("label", T.LongType()), ("vec", T.BinaryType()), ("length", T.DoubleType())]
BLOCK_FIELDS = [
    ("part", T.IntegerType()), ("seq", T.IntegerType()), ("n", T.IntegerType()), ("dim", T.IntegerType()),
    ("longest", T.DoubleType()), ("ids", T.BinaryType()), ("labels", T.BinaryType()), ("mat", T.BinaryType()),
]


def quantised(values: np.ndarray, scale: int, dim: int) -> np.ndarray:
    """floor(scale * x), held within the bounds that let any product of ``dim`` components fit a long."""
    most = int((1 << 31) / max(dim, 1) ** 0.5) - 1
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -most, most).astype(np.int32)


def _vectors(scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = np.array(lists.is_valid()) & np.array(batch.column(0).is_valid())
            good[owner[~np.isfinite(values)]] = False
            values, sizes = values[good[owner]], sizes[good]
            whole = quantised(np.nan_to_num(values), scale, int(sizes.max(initial=0)))
            squares = np.bincount(np.repeat(np.arange(len(sizes)), sizes), whole.astype(np.float64) ** 2, len(sizes))
            ends = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
            vec = pa.Array.from_buffers(
                pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(whole.tobytes())]
            )
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(kept), batch.column(1).filter(kept), vec, pa.array(np.sqrt(squares))],
                [n for n, _ in VECTOR_FIELDS],
            )

    return run


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(id, label, vec, length) of (id, label, vector); rows without an id, or with a vector that is null
    or holds a null or non-finite component, go."""
    return map_batches(rows.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector"), _vectors(scale), VECTOR_FIELDS)


def matrix(rows: list[bytes]) -> np.ndarray:
    """Vectors below one another; shorter ones end in zeros."""
    sizes = {len(x) for x in rows}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(rows), np.int32).reshape(len(rows), -1)
    found = np.zeros((len(rows), max(sizes) // 4), np.int32)
    for i, x in enumerate(rows):
        found[i, : len(x) // 4] = np.frombuffer(x, np.int32)
    return found


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of up to ``most`` consecutive rows, fewer if their bytes are many."""
    ids, labels, vecs, room = [], [], [], 0

    def block():
        return np.array(ids, np.int64), np.array(labels, np.int64), matrix(vecs)

    for batch in batches:
        for i, label, vec in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if vecs and (len(vecs) == most or room + len(vec) > BYTES):
                yield block()
                ids, labels, vecs, room = [], [], [], 0
            ids.append(i)
            labels.append(NONE if label is None else label)
            vecs.append(vec)
            room += len(vec)
    if vecs:
        yield block()


def lengths(mat: np.ndarray) -> np.ndarray:
    return np.sqrt((mat.astype(np.float64) ** 2).sum(1))


def _blocks(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (ids, labels, mat) in enumerate(gathered(batches, most)):
            yield block_row(part, seq, mat, ids, labels)

    return run


def block_row(part: int, seq: int, mat: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    row = (
        part, seq, len(ids), mat.shape[1], float(lengths(mat).max(initial=0)),
        ids.tobytes(), labels.tobytes(), np.ascontiguousarray(mat).tobytes(),
    )
    kinds = [pa.int32()] * 4 + [pa.float64()] + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array([x], t) for x, t in zip(row, kinds)], [n for n, _ in BLOCK_FIELDS]
    )


def blocks(vectors: DataFrame, most: int) -> DataFrame:
    """Consecutive rows of each partition as blocks."""
    return map_batches(vectors.select("id", "label", "vec"), _blocks(most), BLOCK_FIELDS)


@dataclass
class Block:
    """One block in a task."""

    ids: np.ndarray
    labels: np.ndarray
    mat: np.ndarray

    @classmethod
    def read(cls, row: dict, prefix: str) -> Block:
        return cls(
            np.frombuffer(row[f"{prefix}ids"], np.int64), np.frombuffer(row[f"{prefix}labels"], np.int64),
            np.frombuffer(row[f"{prefix}mat"], np.int32).reshape(row[f"{prefix}n"], row[f"{prefix}dim"]),
        )


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of all rows; ``bound``: of the product of two lengths."""
    dim = min(a.shape[1], b.shape[1])
    kind = np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else np.int64
    found = a[:, :dim].astype(kind) @ b[:, :dim].astype(kind).T
    return found.astype(np.int64)


class Best:
    """The k best (score, then smaller id) of each of n rows, as far as seen."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k = k
        self.scores = np.full((n, k), NONE, np.int64)
        self.ids = np.full((n, k), 1 << 62, np.int64)
        self.floor = np.full(n, NONE, np.int64) if floor is None else floor

    def least(self) -> np.ndarray:
        """What a score must reach to be among the best; equal ones still count."""
        return np.maximum(self.scores[:, -1], self.floor)

    def enters(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        last = self.scores[rows, -1]
        return (scores >= self.floor[rows]) & ((scores > last) | ((scores == last) & (ids < self.ids[rows, -1])))

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        met = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(met, self.k)])
        ids = np.concatenate([ids, self.ids[met].ravel()])
        scores = np.concatenate([scores, self.scores[met].ravel()])
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        first = place < self.k
        self.scores[rows[first], place[first]] = scores[first]
        self.ids[rows[first], place[first]] = ids[first]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of all that was found."""
        return np.nonzero((self.scores != NONE) & (self.scores >= self.floor[:, None]))


def spread(blocks: DataFrame) -> int:
    """Groups of the grid: they grow with the blocks, so that a group stays small."""
    conf = blocks.sparkSession.conf
    wanted = max(int(conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // PER_GROUP))
    return min(wanted, MOST_GROUPS)


def grid(queries: DataFrame, rows: DataFrame, on=None) -> DataFrame:
    """Every block of queries beside every block of rows (``on``: pairs that are needed); columns q_, r_."""
    groups = spread(rows)
    queries = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    queries = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    rows = rows.select(
        F.pmod(F.col("part") + F.col("seq"), F.lit(groups)).alias("row_group"),
        *(F.col(c).alias(f"r_{c}") for c in rows.columns),
    )
    same = F.col("group") == F.col("row_group")
    # A merge join keeps the pairs of a query block together.
    return queries.hint("merge").join(rows, same if on is None else same & on).drop("group", "row_group")


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]

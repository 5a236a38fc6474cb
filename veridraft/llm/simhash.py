"""SimHash near-duplicates, found through Golay codewords.

Two fingerprints that differ in at most two of 64 bits agree, in some ordered pair of their
three segments, exactly in the first and up to one bit in the second (pigeonhole). The second
segment is decoded with the perfect binary Golay code [23, 12]: the codewords nearest to it
and to its one-bit neighbours (one or six of them) are its keys, and segments one bit apart
share a key. A join on (pair, exact segment, codeword) therefore finds every link.

No list of all pairs is made: a bucket is joined by its smallest and largest fingerprint,
which settles buckets of two; members of larger buckets are compared through the points one
bit away from them, since two fingerprints are at most two bits apart exactly if they share
such a point. Either way the work per fingerprint is constant, whatever a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veridraft.llm.common import add_columns, map_batches, table
from veridraft.session import materialise

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Segments of the fingerprint: (shift, width).
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Generator of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 digests of the word shingles, as rows of 8 big-endian bytes."""
    from xxhash import xxh64_digest

    words = text.encode().lower().split()  # bytes: A-Z only, and only ASCII white space
    if not words:
        return np.empty((0, 8), np.uint8)
    if len(words) < size:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.frombuffer(b"".join([xxh64_digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)


def fingerprint(text: str) -> int:
    """A bit is 1 if it is set in over half of the hashes; no words: 0. Signed, for a LONG."""
    hashes = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in pieces
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(texts: list[str]) -> tuple[list[int]]:
    return ([fingerprint(x) for x in texts],)


def _remainder(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << bit - 11
    return v


class Golay:
    """Nearest codewords of 23-bit vectors; the number of a codeword is its upper 12 bits."""

    def __init__(self) -> None:
        columns = [_remainder(1 << i) for i in range(23)]
        self.low, self.high = (np.zeros(1 << 12, np.int64) for _ in range(2))
        for i in range(12):
            on = (np.arange(1 << 12) >> i & 1).astype(bool)
            self.low[on] ^= columns[i]
            if i < 11:
                self.high[on] ^= columns[12 + i]
        # Every syndrome belongs to exactly one error of at most three bits.
        self.error = np.zeros(1 << 11, np.int64)
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    error = (1 << a) | (1 << b) | (1 << c)
                    self.error[_remainder(error)] = error

    def number(self, v: np.ndarray) -> np.ndarray:
        return (v ^ self.error[self.low[v & 0xFFF] ^ self.high[v >> 12]]) >> 11

    def near(self, v: np.ndarray, width: int) -> np.ndarray:
        """(n, width + 1): the codeword numbers of v and its one-bit neighbours; repeats are -1."""
        flips = np.array([0] + [1 << i for i in range(width)])
        found = np.sort(self.number(v[:, None] ^ flips), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp.view(np.uint64) >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]


def golay_keys(fp: np.ndarray, golay: Golay, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index into fp): of the nearest codeword only, or of all codewords nearby."""
    parts = _segments(fp)
    keys, owners = [], []
    for j, (_, width) in enumerate(SEGMENTS):
        numbers = golay.near(parts[j], width) if near else golay.number(parts[j])[:, None]
        owner, column = np.nonzero(numbers >= 0)
        for i in range(3):
            if i != j:
                keys.append((i * 3 + j) << 34 | parts[i][owner] << 12 | numbers[owner, column])
                owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners)


def _key_rows(near: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy()
            keys, owner = golay_keys(fp, golay, near)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[owner])], ["key", "fp"])

    return run


def _ball_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.array([0] + [1 << i for i in range(64)], np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy()
        points = (fp.view(np.uint64)[:, None] ^ flips).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(points.ravel()), pa.array(np.repeat(fp, len(flips)))], ["point", "fp"]
        )


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a > b: enough true links (at most two bits) to connect all that are linked."""
    long = T.LongType()
    seek = map_batches(distinct, _key_rows(True), [("key", long), ("fp", long)])
    kept = map_batches(distinct, _key_rows(False), [("key", long), ("fp", long)])
    buckets = kept.groupBy("key").agg(
        F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("n")
    )
    met = seek.join(buckets, "key").where("n > 2 OR low <> fp OR high <> fp")
    met = materialise(
        met.groupBy("fp").agg(
            F.collect_set(F.when(F.bit_count(F.expr("fp ^ low")) <= MAX_BITS, F.col("low"))).alias("lows"),
            F.collect_set(F.when(F.bit_count(F.expr("fp ^ high")) <= MAX_BITS, F.col("high"))).alias("highs"),
            F.max("n").alias("n"),
        ),
        "simhash-met",
    )
    direct = met.select("fp", F.explode(F.array_union("lows", "highs")).alias("other"))
    points = map_batches(met.where("n > 2").select("fp"), _ball_rows, [("point", long), ("fp", long)])
    shared = points.select("fp", F.min("fp").over(Window.partitionBy("point")).alias("other"))
    both = direct.unionByName(shared).where("fp <> other")
    return both.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a > b): alternating large and small stars.

    The rounds grow with the logarithm of the size; each is written and read back, and only a
    count and a checksum come to the driver.
    """
    state = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    edges = materialise(edges, "simhash-edges")
    before = edges.agg(state).first()[0]
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.*").where("a > b").distinct()
        edges = materialise(small, "simhash-edges")
        after = edges.agg(state).first()[0]
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def simhash_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """One row per document: ``columns`` (default: the id), fingerprint, component_id, kept.

    Documents are linked if their fingerprints differ in at most two bits; component_id is
    the smallest id reachable. ``kept`` marks one row of each component: the first with that
    id. Columns of these names are dropped from ``columns``.

    A null text counts as empty (fingerprint 0, linked like any other). A null id counts as
    larger than any other, and is the component's id only if all ids in it are null. No rows
    give no rows.
    """
    added = ["fingerprint", "component_id", "kept"]
    carried = [c for c in columns or [doc_id] if c not in added]
    rows = docs.select(*carried, F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    rows = add_columns(rows, "__text", [("__fp", T.LongType(), pa.int64())], fingerprints, keep_text=False)
    rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")

    first = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    each = materialise(
        rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(first).alias("first")), "simhash-distinct"
    )
    roots = components(links(each.select("fp"))).withColumnRenamed("node", "fp")
    linked = each.join(roots, "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    linked = linked.join(smallest, "root").select("fp", "smallest")
    answers = each.join(linked, "fp", "left").select(
        F.col("fp").alias("__fp"), F.coalesce("smallest", "first").alias("__first")
    )
    return rows.join(materialise(answers, "simhash-answers"), "__fp").select(
        *carried,
        F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        F.col("__first.id").alias("component_id"),
        (F.col("__row") == F.col("__first.row")).alias("kept"),
    )


def op9_simhash(spark, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents"))

"""Mergeable rows in levelled runs: what a stream has found so far, at a bounded price.

Every micro-batch writes its own rows as a run, dealt to buckets by key, and reads nothing.
``fan`` runs of a level are merged into one of the next, so a row is rewritten once per level
and a reader meets at most ``fan`` runs of each. A reader that knows its keys reads their
buckets only.

Runs are folders named by the batches they cover, and count once they are complete
(``_SUCCESS``). A run that lies inside a complete larger one is dead; it is deleted when a
later merge begins, so that whoever was reading it can finish. A crash at any point leaves
either the old runs or both, never a gap, and a batch that is retried replaces its own run.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, FAN = 64, 8
_NAME = re.compile(r"run=(\d+)-(\d+)$")


class Runs:
    """``merge`` turns rows of several runs (with ``run_first``, the run's first batch) into one row per key."""

    def __init__(
        self, spark: SparkSession, root: str, keys: list[str], merge: Callable[[DataFrame], DataFrame],
        buckets: int = BUCKETS, fan: int = FAN,
    ):
        self.spark, self.root, self.keys, self.merge = spark, root.rstrip("/"), keys, merge
        self.buckets, self.fan = buckets, fan

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self) -> list[tuple[int, int]]:
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        found = [(f.getPath(), _NAME.search(f.getPath().getName())) for f in fs.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return [(int(m[1]), int(m[2])) for p, m in found if m and fs.exists(done(p, "_SUCCESS"))]

    def live(self) -> list[tuple[int, int]]:
        """(first, last batch) of the runs that count, in order."""
        kept: list[tuple[int, int]] = []
        for first, last in sorted(self._complete(), key=lambda r: (r[0], -r[1])):
            if not kept or last > kept[-1][1]:
                kept.append((first, last))
        return kept

    def next_batch(self) -> int:
        return max((last + 1 for _, last in self.live()), default=0)

    def merged_away(self, batch_id: int) -> bool:
        """Whether the batch is part of a larger run, and so can't be written again."""
        return any(first <= batch_id <= last and first != last for first, last in self.live())

    def bucket(self, keys: list[Column] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of ``rows`` fall into: as many small numbers as there are buckets, at most."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def _rows(self, runs: list[tuple[int, int]], buckets: list[int] | None) -> DataFrame | None:
        paths = [f"{self.root}/run={first}-{last}" for first, last in runs]
        fs = self._fs()[1]
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        paths = [p for p in paths if len(fs.listStatus(at(p))) > 1]  # more than the mark: not empty
        if not paths or buckets == []:
            return None
        rows = self.spark.read.option("basePath", self.root).parquet(*paths)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.withColumn("run_first", F.split("run", "-")[0].cast("long")).drop("run", "bucket")

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of all runs (of batches below ``before``, of some buckets), not yet merged; None: nothing there."""
        return self._rows([r for r in self.live() if before is None or r[1] < before], buckets)

    def only(self, batch_id: int) -> DataFrame | None:
        """The rows that one batch has put."""
        rows = self._rows([(batch_id, batch_id)], None)
        return None if rows is None else rows.drop("run_first")

    def current(self, buckets: list[int] | None = None) -> DataFrame | None:
        """One row per key."""
        rows = self.read(buckets=buckets)
        return None if rows is None else self.merge(rows).drop("run_first")

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        rows = rows.withColumn("bucket", self.bucket())
        # A hot key's rows are of different flags, windows or events: four files instead of one.
        salt = F.pmod(F.xxhash64(*(c for c in rows.columns if c not in self.keys and c != "bucket")), F.lit(4))
        rows = rows.repartition("bucket", F.when(F.lit(first != last), salt).otherwise(F.lit(0)))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/run={first}-{last}")

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch's own rows; does nothing if they have been merged already."""
        if not self.merged_away(batch_id):
            self._write(rows, batch_id, batch_id)

    def merge_due(self, batch_id: int) -> None:
        """Merge the levels that are full after this batch."""
        size = self.fan
        while (batch_id + 1) % size == 0:
            self.merge_range(batch_id + 1 - size, batch_id)
            size *= self.fan

    def merge_range(self, first: int, last: int) -> None:
        """Merge the live runs that lie in a range of batches into one; then the range is one run."""
        self.vacuum()
        runs = [r for r in self.live() if first <= r[0] and r[1] <= last]
        rows = self._rows(runs, None) if len(runs) > 1 else None
        if rows is not None:
            self._write(self.merge(rows).drop("run_first"), first, last)

    def compact(self) -> None:
        """All runs become one."""
        live = self.live()
        if len(live) > 1:
            self.merge_range(live[0][0], live[-1][1])

    def vacuum(self) -> None:
        """Delete runs that a larger one has replaced."""
        live = set(self.live())
        fs = self._fs()[1]
        for first, last in self._complete():
            if (first, last) not in live:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/run={first}-{last}"), True)


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A merge in which the row of the latest batch wins."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "run_first")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "run_first").alias("s")).select(*keys, "s.*")

    return merge

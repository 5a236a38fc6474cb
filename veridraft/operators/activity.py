"""Decision activity over time (batch side of B15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling_activity(decisions: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Decisions per reviewer and action in tumbling (or sliding) windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return decisions.groupBy(window.alias("w"), "reviewed_by", "action").agg(
        F.count(F.lit(1)).alias("decisions")
    ).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "reviewed_by", "action", "decisions",
    )


def session_activity(
    decisions: DataFrame, gap_seconds: int = 1800, keys: tuple[str, ...] = ("reviewed_by", "action")
) -> DataFrame:
    """Sessions per reviewer and action: a new one starts after ``gap_seconds`` without a
    decision.

    Two decisions inside one time bucket as wide as the gap are always in the same session,
    so the log is first reduced to one row per key and bucket. The ordered part then works
    on at most (time span / gap) rows per key, however busy that key is.
    """
    gap = gap_seconds * 1_000_000
    micros = F.unix_micros("ts")
    buckets = decisions.groupBy(*keys, F.floor(micros / gap).cast("bigint").alias("bucket")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")
    )
    by_time = Window.partitionBy(*keys).orderBy("bucket")
    idle = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(by_time))
    starts = F.when(idle < gap, 0).otherwise(1)
    numbered = buckets.withColumn("_new", starts).withColumn("session_no", F.sum("_new").over(by_time))
    return numbered.groupBy(*keys, "session_no").agg(
        F.min("first_ts").alias("session_start"),
        F.max("last_ts").alias("last_decision"),
        F.sum("n").alias("decisions"),
    )

"""Streams that keep a small table up to date."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from veridraft.functions.columns import mapped
from veridraft.operators.activity import tumbling_activity
from veridraft.operators.stages import STAGE_RANK, furthest_stage, with_stage
from veridraft.streaming.runs import Runs, newest


STAGE_KEYS = ["audit_id"]
#: Groups that ``stuck_stream`` deals audits to: calls into Python grow with them at most, not with the audits.
STUCK_BUCKETS = 1 << 15


def _merged_stages(rows: DataFrame) -> DataFrame:
    return with_stage(rows.groupBy(*STAGE_KEYS).agg(
        F.max("stage_rank").alias("stage_rank"), F.max("last_ts").alias("last_ts"), F.sum("events").alias("events")
    ))


def stage_table(spark: SparkSession, root: str) -> Runs:
    """B14. The table that ``start_stages`` keeps; ``current()`` is the furthest stage per audit."""
    return Runs(spark, root, STAGE_KEYS, _merged_stages)


def start_stages(stage_events: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """B14. Furthest stage per audit. Each batch is reduced to its own furthest stages and
    merged when read: the maximum makes that safe against any disorder, and no state is kept."""

    def add(batch: DataFrame, batch_id: int) -> None:
        table = stage_table(batch.sparkSession, root)
        table.put(furthest_stage(batch), batch_id)
        table.merge_due(batch_id)

    return _started(stage_events.writeStream, add, checkpoint, trigger)


def stuck_stream(
    stage_events: DataFrame, idle: str = "24 hours", late: str = "1 hour", forget: str = "7 days"
) -> DataFrame:
    """B14. Audits without an event for ``idle``, put out when the watermark says so.

    The furthest stage counts, whatever the order of arrival: an audit that has completed or
    failed, or was put out, stays known for ``forget`` after its last event. So an earlier
    stage that arrives late doesn't open it again, and one that goes on and gets stuck once
    more is put out with the furthest stage it ever reached. After that it is forgotten: the
    state holds audits with an event in the last ``idle`` + ``forget`` only.

    Audits share ``STUCK_BUCKETS`` states by hash; a bucket's timer is that of its next audit.
    """
    wait, keep = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (idle, forget))
    final = STAGE_RANK["COMPLETED"]

    def until(known) -> int:
        _rank, last, settled = known
        return last // 1000 + wait + (keep if settled else 0)

    def follow(_key, batches, state):
        known = {a: rest for a, *rest in zip(*state.get)} if state.exists else {}
        now, seen, stuck = state.getCurrentWatermarkMs(), set(), []
        for batch in [] if state.hasTimedOut else batches:
            for audit, stage, us in zip(batch["audit_id"].tolist(), batch["rank"].tolist(), batch["us"].tolist()):
                rank, last, settled = known.get(audit, (-1, 0, False))
                rank = max(rank, stage)
                known[audit] = rank, max(last, us), settled and us <= last or rank >= final
                seen.add(audit)
        # Audits that are heard of in this batch wait for the next one.
        for audit in [a for a, k in known.items() if a not in seen and until(k) <= now]:
            rank, last, settled = known[audit]
            if settled:
                del known[audit]
            else:
                stuck.append((audit, rank, last))
                known[audit] = rank, last, True
        if stuck:
            yield pd.DataFrame(stuck, columns=["audit_id", "stage_rank", "last_us"])
        if known:
            state.update(tuple(map(list, zip(*((a, *k) for a, k in known.items())))))
            # A timer fires when the watermark is past it.
            state.setTimeoutTimestamp(max(min(map(until, known.values())) - 1, now + 1))
        else:
            state.remove()

    rank = F.when(F.col("status") == "FAILED", final + 1).otherwise(mapped(F.col("status"), STAGE_RANK, -1))
    events = stage_events.withWatermark("ts", late).select(
        F.pmod(F.xxhash64("audit_id"), F.lit(STUCK_BUCKETS)).cast("int").alias("bucket"),
        "audit_id", "ts", rank.alias("rank"), F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("us"),
    )
    return events.groupBy("bucket").applyInPandasWithState(
        follow, "audit_id string, stage_rank int, last_us long",
        "audits array<string>, ranks array<int>, last array<long>, settled array<boolean>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def decision_windows(decisions: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """B15. Tumbling or sliding counts; decisions later than ``late`` are dropped."""
    return tumbling_activity(decisions.withWatermark("ts", late), size, slide)


def decision_sessions(
    decisions: DataFrame,
    late: str = "1 hour",
    gap: str = "30 minutes",
    keys: tuple[str, ...] = ("reviewed_by", "action"),
) -> DataFrame:
    """B15. Sessions per reviewer and action, merged inside the map tasks first (see
    ``session``)."""
    return (
        decisions.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("decisions"))
        .select(
            *keys, F.col("w.start").alias("session_start"),
            F.col("w.end").alias("session_end"), "decisions",
        )
    )


def _started(writer, add, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .foreachBatch(add)
        .start()
    )


def start_table(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "update", keys: list[str] | None = None, **trigger
) -> StreamingQuery:
    """Write every batch of changed rows; a retried batch replaces its own. With ``keys`` the
    rows of a key replace one another and old runs are merged: read them with ``latest_rows``."""

    def append(batch: DataFrame, batch_id: int) -> None:
        if keys is None:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            return
        table = Runs(batch.sparkSession, path, keys, newest(keys))
        table.put(batch, batch_id)
        table.merge_due(batch_id)

    return _started(stream.writeStream.outputMode(mode), append, checkpoint, trigger)


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current content of a table written in update mode."""
    return Runs(spark, path, keys, newest(keys)).current()

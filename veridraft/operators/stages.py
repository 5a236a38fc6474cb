"""Ingestion stages (A72, batch side of B14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft import domains as D
from veridraft.functions.columns import mapped

SHOWN_RANK = {s: i + 1 for i, (s, _) in enumerate(D.SHOWN_STAGES)}
STAGE_RANK = {s: i for i, s in enumerate(D.ALL_STAGES)}


def completed_stages(stage_events: DataFrame) -> DataFrame:
    """Per audit: how many of the shown stages are done (the furthest one counts)."""
    done = mapped(F.col("status"), {**SHOWN_RANK, "COMPLETED": len(SHOWN_RANK)}, 0)
    return stage_events.groupBy("audit_id").agg(F.max(done).alias("done"))


def stage_board(stage_events: DataFrame) -> DataFrame:
    """A72. Six rows per audit. The board is an array literal, so nothing is joined."""
    board = F.array(*[
        F.struct(F.lit(i + 1).alias("stage_no"), F.lit(s).alias("stage"), F.lit(text).alias("label"))
        for i, (s, text) in enumerate(D.SHOWN_STAGES)
    ])
    total = len(D.SHOWN_STAGES)
    done = F.col("done")
    return completed_stages(stage_events).select(
        "audit_id", "done", F.explode(board).alias("s")
    ).select(
        "audit_id",
        "s.*",
        F.when(done >= F.col("s.stage_no"), "done")
        .when(done + 1 == F.col("s.stage_no"), "current")
        .otherwise("pending")
        .alias("state"),
        F.when(done >= total, "READY")
        .otherwise(
            F.concat(F.least(F.lit(100), F.round(F.lit(100.0) * done / total)).cast("int").cast("string"), F.lit("%"))
        )
        .alias("progress"),
    )


def furthest_stage(stage_events: DataFrame) -> DataFrame:
    """B14 (batch). Furthest stage per audit whatever the arrival order; FAILED is final."""
    rank = F.when(F.col("status") == "FAILED", len(D.ALL_STAGES)).otherwise(
        mapped(F.col("status"), STAGE_RANK, -1)
    )
    return with_stage(stage_events.groupBy("audit_id").agg(
        F.max(rank).alias("stage_rank"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("events"),
    ))


def with_stage(ranked: DataFrame) -> DataFrame:
    names = {**{i: s for s, i in STAGE_RANK.items()}, len(D.ALL_STAGES): "FAILED"}
    return ranked.withColumn("stage", mapped(F.col("stage_rank"), names))


def stuck_audits(furthest: DataFrame, now, idle_seconds: int) -> DataFrame:
    """B14. Unfinished audits with no event for ``idle_seconds`` before ``now``."""
    limit = F.unix_micros(now) - F.lit(idle_seconds * 1_000_000).cast("bigint")
    return furthest.where(
        (F.col("stage_rank") < STAGE_RANK["COMPLETED"]) & (F.unix_micros(F.col("last_ts")) < limit)
    )

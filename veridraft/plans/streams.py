"""Registered queries that run a stream over the events table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridraft.plans.decisions import BOTH, PROCESSED_COLUMNS, PROCESSED_SQL
from veridraft.plans.passports import STAGE_SQL, STAGE_STATUS_SQL, session_sql
from veridraft.plans.registry import query
from veridraft.session import work_dir
from veridraft.sources.adapters import decisions_from_events, stage_events_from_events
from veridraft.streaming import rescoring, tables


def _events(v):
    schema = v.table("events").schema
    return v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)


def _finish(stream_query):
    stream_query.awaitTermination()


@query("b12_live_scores", PROCESSED_SQL, BOTH)
def _(v):
    path = work_dir(v.spark, "flag-state")
    stream = decisions_from_events(_events(v))
    _finish(rescoring.start_rescoring(stream, f"{path}/flags", f"{path}/checkpoint", availableNow=True))
    states = rescoring.DecisionLog(v.spark, f"{path}/flags").states()
    return rescoring.live_scores(v.decision_audits(), v.decision_flags(), states).select(*PROCESSED_COLUMNS)


@query("b14_live_stages", STAGE_STATUS_SQL, ("v_stage_events",))
def _(v):
    path = work_dir(v.spark, "stages")
    stream = stage_events_from_events(_events(v))
    _finish(tables.start_stages(stream, f"{path}/stages", f"{path}/checkpoint", availableNow=True))
    rows = tables.stage_table(v.spark, f"{path}/stages").current()
    return rows.withColumn("last_us", F.unix_micros("last_ts")).drop("last_ts")


@query(
    "b15_live_windows",
    """SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, reviewed_by, action, count(*) AS decisions FROM v_decisions GROUP BY ALL""",
    ("v_decisions",),
)
def _(v):
    path = work_dir(v.spark, "windows")
    stream = tables.decision_windows(decisions_from_events(_events(v)))
    keys = ["window_start", "window_end", "reviewed_by", "action"]
    _finish(tables.start_table(stream, f"{path}/log", f"{path}/checkpoint", keys=keys, availableNow=True))
    rows = tables.latest_rows(v.spark, f"{path}/log", keys)
    return rows.select(F.unix_micros("window_start").alias("start_us"), "reviewed_by", "action", "decisions")


@query(
    "b14_live_stuck",
    f"""SELECT audit_id, CAST(stage_rank AS INT) AS stage_rank, last_us FROM ({STAGE_SQL}) x WHERE stage_rank < 8
        AND last_us // 1000 + 86400000 <= (SELECT epoch_us(max(ts)) FROM v_stage_events) // 1000 - 3600000""",
    ("v_stage_events",),
)
def _(v):
    path = work_dir(v.spark, "stuck")
    stream = tables.stuck_stream(stage_events_from_events(_events(v)))
    _finish(tables.start_table(stream, f"{path}/log", f"{path}/checkpoint", "append", availableNow=True))
    return v.spark.read.parquet(f"{path}/log").drop("batch_id")


@query(
    "b15_live_sliding",
    """SELECT epoch_us(time_bucket(INTERVAL '30 minutes', ts)) - k * 1800000000 AS start_us, reviewed_by, action, count(*) AS decisions
       FROM v_decisions CROSS JOIN range(0, 2) r(k) GROUP BY ALL""",
    ("v_decisions",),
)
def _(v):
    path = work_dir(v.spark, "sliding")
    stream = tables.decision_windows(decisions_from_events(_events(v)), slide="30 minutes")
    keys = ["window_start", "window_end", "reviewed_by", "action"]
    _finish(tables.start_table(stream, f"{path}/log", f"{path}/checkpoint", keys=keys, availableNow=True))
    rows = tables.latest_rows(v.spark, f"{path}/log", keys)
    return rows.select(F.unix_micros("window_start").alias("start_us"), "reviewed_by", "action", "decisions")


@query(
    "b15_live_sessions",
    f"""SELECT reviewed_by, action, start_us, decisions FROM ({session_sql('reviewed_by, action')}) s
        WHERE last_us + 1800000000 <= (SELECT epoch_us(max(ts)) FROM v_decisions) - 3600000000""",
    ("v_decisions",),
)
def _(v):
    # sessions that the watermark has closed
    path = work_dir(v.spark, "sessions")
    stream = tables.decision_sessions(decisions_from_events(_events(v)))
    _finish(tables.start_table(stream, f"{path}/log", f"{path}/checkpoint", "append", availableNow=True))
    rows = v.spark.read.parquet(f"{path}/log")
    return rows.select("reviewed_by", "action", F.unix_micros("session_start").alias("start_us"), "decisions")

"""Streams give what the batch operators give on the same rows."""

from __future__ import annotations

import contextlib
import os
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from tests.scans import scanned
from veridraft.operators import activity, decisions, stages
from veridraft.sources.adapters import Views
from veridraft.operators.stages import STAGE_RANK
from veridraft.streaming import rescoring, tables

FOLDER = "/root/testdata/sf0.001"


def _split(df, path, parts, order):
    """Write the rows as several files, in the given order of time."""
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(path)
    _date_files(path)


def _date_files(path, start=1_000_000_000):
    """Files are taken in order of their age; make that order the order of their names."""
    for i, file in enumerate(sorted(Path(path).glob("part-*.parquet"))):
        os.utime(file, (start + i, start + i))


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_live_scores_equal_batch(spark, tmp_path):
    v = Views(spark, FOLDER)
    log = v.decisions()
    # newest first, and a third of the rows delivered twice
    _split(log, f"{tmp_path}/in", 4, F.desc("ts"))
    log.where("decision_id % 3 = 0").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = rescoring.start_rescoring(
        _stream(spark, f"{tmp_path}/in", log.schema), f"{tmp_path}/flags", f"{tmp_path}/cp", availableNow=True
    )
    query.awaitTermination()
    state = rescoring.DecisionLog(spark, f"{tmp_path}/flags").states()
    columns = ["audit_id", "trust_score", "findings_count", "status", "reviewer_decision_count"]
    live = rescoring.live_scores(v.decision_audits(), v.decision_flags(), state).select(*columns)
    batch = decisions.process_decisions(v.decision_audits(), v.decision_flags(), log)["audits"].select(*columns)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))
    assert rescoring.DecisionLog(spark, f"{tmp_path}/flags").decisions().count() == log.count()
    table = rescoring.DecisionLog(spark, f"{tmp_path}/flags")
    before = sorted(map(str, state.collect()))
    table.compact()
    assert len(table.log.live()) == len(table.runs.live()) == 1
    assert sorted(map(str, table.states().select(*state.columns).collect())) == before


def test_retried_batch_counts_once(spark, tmp_path):
    log = Views(spark, FOLDER).decisions()
    table = rescoring.DecisionLog(spark, f"{tmp_path}/flags")
    table.add(log.where("decision_id % 2 = 0"), 0)
    for _ in range(2):  # the second one replaces the first
        table.add(log.where("decision_id % 2 = 1 OR decision_id % 5 = 0"), 1)
    want = decisions.flag_states(log)
    got = table.states().select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _states(df) -> list[str]:
    columns = ["_k", "flag_id", "status_at", "note_at", "decided_at", "decision_count"]
    return sorted(map(str, df.select(*columns).collect()))


def test_redelivered_with_another_time(spark, tmp_path):
    """The earliest delivery of a decision counts, in whatever order the deliveries come."""
    log = Views(spark, FOLDER).decisions()
    table = rescoring.DecisionLog(spark, f"{tmp_path}/d", buckets=4, fan=2)
    late = log.withColumn("ts", F.expr("ts + INTERVAL 3 DAYS"))
    parts = [late.where("decision_id % 2 = 0"), log.where("decision_id % 3 = 0"), log, late.where("decision_id % 5 = 0")]
    for k, part in enumerate(parts):
        table.add(part, k)
        every = parts[0]
        for more in parts[1 : k + 1]:
            every = every.unionByName(more)
        assert _states(table.states()) == _states(decisions.flag_states(decisions.first_deliveries(every)))
    assert table.decisions().count() == log.count()


def test_many_batches_read_what_they_touch(spark, tmp_path):
    """Few runs however many batches; a batch reads its audits' buckets only."""
    log = Views(spark, FOLDER).decisions().withColumn("audit_id", F.concat(F.lit("AUD-"), F.col("decision_id") % 500))
    rows = log.where("decision_id < 2000").toPandas()
    table = rescoring.DecisionLog(spark, f"{tmp_path}/d", buckets=16, fan=3)
    size, batches = 20, 14
    for k in range(batches):
        table.add(spark.createDataFrame(rows[k * size : (k + 1) * size], log.schema).coalesce(1), k)
        assert len(table.log.live()) <= 6 and len(table.runs.live()) <= 6
    done = spark.createDataFrame(rows[: batches * size], log.schema)
    assert _states(table.states()) == _states(decisions.flag_states(done))
    one = spark.createDataFrame(rows[:1], log.schema).withColumn("_k", F.lower("audit_id"))
    read = scanned(table.known(table.log.buckets_of(one)))
    assert read["rows"] < batches * size / 4 and read["files"] <= len(table.log.live()) * 4
    assert scanned(table.known(list(range(16))))["rows"] >= batches * size


def test_crash_between_write_and_merge(spark, tmp_path, monkeypatch):
    """Whatever was written when it happened, the batch comes again and counts once."""
    log = Views(spark, FOLDER).decisions().where("decision_id < 400").coalesce(1)
    part = lambda k: log.where(f"decision_id % 4 = {k}")
    runs = type(rescoring.DecisionLog(spark, f"{tmp_path}/x").log)
    for n, (broken, after) in enumerate([("put", 2), ("merge_due", 1), ("_write", 3)]):
        table = rescoring.DecisionLog(spark, f"{tmp_path}/{n}{after}", buckets=4, fan=2)
        table.add(part(0), 0)
        calls, real = [0], getattr(runs, broken)

        def fails(self, *args, real=real, calls=calls, after=after):
            calls[0] += 1
            if calls[0] == after:
                raise OSError("lost")
            return real(self, *args)

        monkeypatch.setattr(runs, broken, fails)
        with contextlib.suppress(OSError):
            table.add(part(1), 1)
        monkeypatch.setattr(runs, broken, real)
        table.add(part(1), 1)
        table.add(part(2), 2)
        want = decisions.flag_states(log.where("decision_id % 4 < 3"))
        assert _states(table.states()) == _states(want), (broken, after)


def test_live_stages_equal_batch(spark, tmp_path):
    v = Views(spark, FOLDER)
    events = v.stage_events()
    _split(events, f"{tmp_path}/in", 3, F.desc("ts"))
    stream = _stream(spark, f"{tmp_path}/in", events.schema)
    tables.start_stages(stream, f"{tmp_path}/stages", f"{tmp_path}/cp", availableNow=True).awaitTermination()
    live = tables.stage_table(spark, f"{tmp_path}/stages").current()
    batch = stages.furthest_stage(events)
    assert sorted(map(tuple, live.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_windows_drop_late_rows(spark, tmp_path):
    v = Views(spark, FOLDER)
    log = v.decisions()
    _split(log, f"{tmp_path}/in", 4, F.col("ts"))
    schema = log.schema

    keys = ["window_start", "window_end", "reviewed_by", "action"]
    stream = tables.decision_windows(_stream(spark, f"{tmp_path}/in", schema), late="1 hour")
    tables.start_table(stream, f"{tmp_path}/log", f"{tmp_path}/cp", keys=keys, availableNow=True).awaitTermination()
    live = tables.latest_rows(spark, f"{tmp_path}/log", keys)
    batch = activity.tumbling_activity(log)
    assert sorted(map(tuple, live.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))

    # the oldest rows again, long after the watermark has passed: nothing changes
    log.orderBy("ts").limit(50).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = tables.decision_windows(_stream(spark, f"{tmp_path}/in", schema), late="1 hour")
    tables.start_table(stream, f"{tmp_path}/log", f"{tmp_path}/cp", keys=keys, availableNow=True).awaitTermination()
    live = tables.latest_rows(spark, f"{tmp_path}/log", keys)
    assert sorted(map(tuple, live.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_session_stream(spark, tmp_path):
    """Exactly the sessions the watermark has closed."""
    v = Views(spark, FOLDER)
    log = v.decisions()
    _split(log, f"{tmp_path}/in", 3, F.col("ts"))
    stream = tables.decision_sessions(_stream(spark, f"{tmp_path}/in", log.schema), late="1 hour")
    tables.start_table(stream, f"{tmp_path}/log", f"{tmp_path}/cp", mode="append", availableNow=True).awaitTermination()
    live = spark.read.parquet(f"{tmp_path}/log")
    batch = activity.session_activity(log, 1800).where(
        F.col("last_decision") + F.expr("INTERVAL 30 MINUTES") <= F.lit(log.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 1 HOUR")
    )
    columns = ["reviewed_by", "action", "session_start", "decisions"]
    assert sorted(map(tuple, batch.select(*columns).collect())) == sorted(map(tuple, live.select(*columns).collect()))


def _stuck(spark, tmp_path, batches, **options):
    """What the stream puts out, batch by batch of (audit, status, hour), and the rows left in its state."""
    start = datetime(2026, 1, 1)
    for k, part in enumerate(batches):
        rows = [(a, s, start + timedelta(hours=h)) for a, s, h in part]
        df = spark.createDataFrame(rows, "audit_id string, status string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        newest = max(Path(f"{tmp_path}/in").glob("part-*.parquet"), key=lambda f: f.stat().st_mtime_ns)
        newest.rename(newest.with_name(f"part-{k}.parquet"))
    _date_files(f"{tmp_path}/in")
    stream = tables.stuck_stream(_stream(spark, f"{tmp_path}/in", df.schema), **options)
    query = tables.start_table(stream, f"{tmp_path}/log", f"{tmp_path}/cp", mode="append", availableNow=True)
    query.awaitTermination()
    rows = sorted((r.audit_id, r.stage_rank) for r in spark.read.parquet(f"{tmp_path}/log").collect())
    return rows, query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_stuck_stream_releases_finished_audits(spark, tmp_path):
    found, _left = _stuck(spark, tmp_path, [
        [("done", "UPLOADING", 0), ("stuck", "PARSING", 0), ("late", "PARSING", 0)],
        [("done", "COMPLETED", 5), ("failed", "FAILED", 6), ("late", "INDEXING", 20)],
        [("new", "QUEUED", 50), ("end", "COMPLETED", 60)],
    ])
    assert found == [("late", 5), ("stuck", 2)]


def test_settled_audits_stay_known(spark, tmp_path):
    """A stage that arrives after the end doesn't open an audit; one put out keeps its furthest stage."""
    found, left = _stuck(spark, tmp_path, [
        [("a", "COMPLETED", 10), ("b", "VERIFYING", 10)],
        [("a", "PARSING", 9.9), ("c", "COMPLETED", 40)],  # b has been idle for a day now
        [("d", "COMPLETED", 42)], [("b", "PARSING", 43)],  # and goes on
        [("e", "COMPLETED", 80)],  # and is idle again
    ])
    assert found == [("b", 7), ("b", 7)] and left == 5
    found, left = _stuck(spark, tmp_path / "x", [
        [(f"{k}-{i}", "COMPLETED" if i % 2 else "PARSING", 100 * k) for i in range(20)] for k in range(6)
    ], forget="2 days")
    assert len(found) == 50 and left <= 40  # of 120 audits


def test_many_audits_share_few_states(spark, tmp_path, monkeypatch):
    """Hundreds of audits meet in a few states; what is put out is that of audits on their own."""
    monkeypatch.setattr(tables, "STUCK_BUCKETS", 4, raising=False)
    found, left = _stuck(spark, tmp_path, [
        [(f"a{i}", "COMPLETED" if i % 3 == 0 else "PARSING", i / 30) for i in range(300)],
        [(f"a{i}", "INDEXING", 20 + i / 30) for i in range(0, 300, 5)], [("late", "QUEUED", 40)], [("end", "COMPLETED", 60)],
    ])
    want = [(f"a{i}", STAGE_RANK["INDEXING" if i % 5 == 0 else "PARSING"]) for i in range(300) if i % 3]
    assert found == sorted(want) and left <= 4

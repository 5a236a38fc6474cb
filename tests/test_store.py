from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests import golden
from tests.test_golden import REPLAY, _log
from veridraft.store import AuditStore


@pytest.fixture()
def store(spark, tmp_path):
    return AuditStore(spark, str(tmp_path))


def test_replay_through_the_store(spark, store):
    t = golden.tables(spark)
    store.append("flags", t["flags"])
    store.append("audits", t["audits"])
    assert [r.audit_id for r in store.audits().collect()][0] == "AUD-1042"
    log = _log(spark, REPLAY)
    for i, (_a, _f, score, band, findings, status) in enumerate(REPLAY):
        assert store.submit_decisions(log.where(F.col("decision_id") == i + 1)).count() == 0
        row = store.audit("aud-1042").first()
        assert (row.trust_score, row.risk_band, row.findings_count, row.status) == (score, band, findings, status)
        assert row.reviewer_decision_count == i + 1
    assert [r.status for r in store.flags("AUD-1042").collect()] == ["DISMISSED", "DISMISSED", "FIXED", "FIXED"]
    assert store.audits().count() == 5
    assert store.audit("AUD-1088").first().trust_score == 58  # untouched
    assert store.decision_history().count() == 5
    rejected = store.submit_decisions(log.where("decision_id = 1").withColumn("flag_id", F.lit("FLG-x")))
    assert [r.reason for r in rejected.collect()] == ["Flag not found"]


def test_create_and_read_back(spark, store):
    now = datetime(2026, 10, 9)
    submissions = spark.createDataFrame(
        [(1, "AUD-1", "", "Technical Spec", "English", "spec.v2.pdf", "2.4 MB", now), (2, "AUD-2", "Given", "Technical Spec", "English", "b", "77", now)],
        "seq bigint, audit_id string, title string, document_type string, language string, file_name string, file_size string, ts timestamp",
    )
    files = spark.createDataFrame(
        [("AUD-1", 0, "S1", "po.pdf", "10", None, "h"), ("AUD-1", 1, "S2", "plan.xlsx", "1 MB", None, "h"), ("AUD-2", 0, "S3", "x.txt", None, "DRAFT", "h")],
        "audit_id string, ord int, source_id string, name string, size string, authority string, hash string",
    )
    store.create_audits(submissions, files)
    rows = {r.audit_id: r for r in store.audits().collect()}
    assert (rows["AUD-1"].title, rows["AUD-2"].title) == ("spec.v2", "Given")
    assert (rows["AUD-1"].status, rows["AUD-1"].processing_status, rows["AUD-1"].trust_score) == ("PROCESSING", "COMPLETED", 72)
    assert (rows["AUD-1"].ai_document.size, rows["AUD-2"].ai_document.size) == ("2.4 MB", "1.8 MB")
    sources = {r.source_id: r for r in store.table("source_documents").collect()}
    assert [sources[s].authority for s in ("S1", "S2", "S3")] == ["LATEST_APPROVED", "SIGNED_EXECUTED", "DRAFT"]
    assert [sources[s].type for s in ("S1", "S2", "S3")] == ["Purchase Order", "Commercial Schedule", "Policy Doc"]
    assert [sources[s].size_bytes for s in ("S1", "S2", "S3")] == [10, 1240000, 1240000]
    flag = store.flags("aud-1").first()
    assert (flag.impact_score, flag.evidence.source_name, flag.status) == (-28, "po.pdf", "PENDING")
    assert store.claims("AUD-2").count() == 1
    assert store.table("waterfall").where("audit_id = 'AUD-1'").count() == 2
    status = store.audit_status("AUD-1").first()
    assert (status.progress_percent, status.current_stage) == (75, "Analysis complete")


def test_empty_store(spark, store):
    assert store.audits().count() == 0
    asked = spark.createDataFrame([("PASSPORT-1",)], "token string")
    assert store.verify(asked).first().outcome == "INVALID"
    ids = spark.createDataFrame([("AUD-1",)], "audit_id string")
    assert store.passport(ids).first().is_fallback


def test_one_audit_prunes_the_scan(spark, store, capsys):
    """The stored key reaches the scans of audits and children."""
    t = golden.tables(spark)
    store.append("flags", t["flags"])
    store.append("audits", t["audits"])
    from veridraft.sources.audits import children_of, get_audit

    audits, flags = store.table("audits"), store.table("flags")
    for rows in (get_audit(audits, "AUD-1042", strict=False), children_of(audits, flags, "AUD-1042")):
        rows.explain()
        assert "EqualTo(audit_key,aud-1042)" in capsys.readouterr().out and rows.count() > 0


def test_one_audit_reads_one_bucket(spark, store):
    """A point read meets one bucket of the states, whatever else was decided."""
    from tests.scans import scanned

    t = golden.tables(spark)
    flag, audit = t["flags"].where("audit_id = 'AUD-1042'").limit(1), t["audits"].where("audit_id = 'AUD-1042'")
    ids = spark.range(300).select(F.concat(F.lit("AUD-x"), "id").alias("_a"))
    store.append("flags", flag.drop("audit_id").crossJoin(ids).withColumnRenamed("_a", "audit_id").select(*flag.columns).unionByName(t["flags"]))
    store.append("audits", audit.drop("audit_id").crossJoin(ids).withColumnRenamed("_a", "audit_id").select(*audit.columns).unionByName(t["audits"]))
    flag_id = flag.first().flag_id
    log = ids.select(
        F.xxhash64("_a").alias("decision_id"), F.col("_a").alias("audit_id"), F.lit(flag_id).alias("flag_id"),
        F.lit("DISMISS").alias("action"), F.lit("why").alias("note"), F.lit("r").alias("reviewed_by"),
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"),
    )
    assert store.submit_decisions(log).count() == 0
    every, one = scanned(store._log().states()), scanned(store._log().states("aud-X7"))
    assert every["rows"] == 300 and one["rows"] < 30 and one["files"] * 10 < every["files"]
    assert store.audit("AUD-X7").first().reviewer_decision_count == 1
    assert store.flags("aud-x7").first().status == "DISMISSED"

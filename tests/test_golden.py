from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests import golden
from veridraft.operators import decisions, evidence, passports, scoring, triage
from veridraft.sources import audits as audit_source


@pytest.fixture(scope="module")
def t(spark):
    return golden.tables(spark)


def test_dashboard(t):
    row = triage.dashboard(t["audits"]).first()
    assert tuple(row) == (5, 1, 3, 1, 1, 66, 94)


def test_dashboard_of_nothing_has_no_averages(t):
    row = triage.dashboard(t["audits"].where("false")).first()
    assert tuple(row) == (0, 0, 0, 0, 0, None, None)


def test_queue_order_is_stable(t):
    rows = triage.review_queue(t["audits"]).orderBy("position").collect()
    assert [r.audit_id for r in rows] == ["AUD-1042", "AUD-1088", "AUD-1115", "AUD-1120", "AUD-1104"]
    assert [r.position for r in rows] == [1, 2, 3, 4, 5]


def test_queue_unknown_priority_sorts_last(spark, t):
    odd = spark.createDataFrame(
        [(9, "AUD-9", "t", "d", "VERIFIED", "WEIRD", 1, None, 0)], golden.AUDIT_SCHEMA
    )
    rows = triage.review_queue(t["audits"].unionByName(odd)).orderBy("position").collect()
    assert rows[-1].audit_id == "AUD-9" and rows[-1].severity_rank == 99


def test_search_is_literal_and_case_insensitive(t):
    def found(q):
        return {r.audit_id for r in triage.search_audits(t["audits"], q).collect()}

    assert found("aud-11") == {"AUD-1104", "AUD-1115", "AUD-1120"}
    assert found("PROCUREMENT") == {"AUD-1042"}
    assert found("%") == set() and found("_v1.") == {"AUD-1088"}
    assert len(found("")) == 5
    assert triage.filter_risk(t["audits"], "NORMAL").count() == 0


def test_recent_and_headline(t):
    assert [r.audit_id for r in triage.recent_audits(t["audits"]).collect()] == [
        "AUD-1042", "AUD-1088", "AUD-1104", "AUD-1115"
    ]
    # first urgent one in list order, not the worst one
    later = t["audits"].withColumn("seq", F.when(F.col("audit_id") == "AUD-1088", 99).otherwise(F.col("seq")))
    assert triage.headline_audit(later).first().audit_id == "AUD-1088"
    assert triage.headline_audit(t["audits"].where("priority = 'LOW'")).first().audit_id == "AUD-1104"


def test_result_summary(t):
    rows = {
        r.audit_id: tuple(r)[1:]
        for r in scoring.result_summary(t["audits"], t["claims"], t["sources"], t["flags"]).collect()
    }
    assert rows["AUD-1042"] == (4, 4, 4, 0, 0, 2, 2, 0, 0, "FINDINGS_PRESENT")
    assert rows["AUD-1088"] == (4, 4, 1, 0, 0, 0, 1, 0, 0, "FINDINGS_PRESENT")
    assert rows["AUD-1104"] == (4, 4, 0, 0, 0, 0, 0, 0, 0, "NO_FINDINGS")
    assert rows["AUD-1120"] == (4, 0, 0, 0, 0, 0, 0, 0, 0, "PROCESSING")
    true_counts = scoring.result_summary(t["audits"], t["claims"], t["sources"], t["flags"], fallback=0)
    assert true_counts.where("audit_id = 'AUD-1088'").first().claims_checked == 0


def test_stored_summary_wins(t):
    stored = t["audits"].withColumn(
        "result_summary",
        F.when(
            F.col("audit_id") == "AUD-1042",
            F.expr(
                "named_struct('claims_checked', 9, 'evidence_matched', 8, 'contradictions', 7,"
                " 'unsupported_claims', 6, 'uncertain_claims', 5, 'critical_findings', 4, 'high_findings', 3,"
                " 'medium_findings', 2, 'low_findings', 1, 'result_state', 'PARTIAL')"
            ),
        ),
    )
    rows = {
        r.audit_id: tuple(r)[1:]
        for r in scoring.result_summary(stored, t["claims"], t["sources"], t["flags"]).collect()
    }
    assert rows["AUD-1042"] == (9, 8, 7, 6, 5, 4, 3, 2, 1, "PARTIAL")
    assert rows["AUD-1120"][-1] == "PROCESSING"


REPLAY = [
    ("ACCEPT", "FLG-101", 42, "High Risk", 4, "REVIEW REQUIRED"),
    ("DISMISS", "FLG-102", 56, "Review Needed", 3, "REVIEW REQUIRED"),
    ("FIX", "FLG-103", 66, "Review Needed", 2, "REVIEW REQUIRED"),
    ("DISMISS", "FLG-101", 94, "Trustworthy", 1, "REVIEW REQUIRED"),
    ("FIX", "FLG-104", 100, "Trustworthy", 0, "VERIFIED"),
]


def _log(spark, steps):
    start = datetime(2026, 10, 9)
    rows = [
        (i + 1, "aud-1042", flag, action, None, "r", start + timedelta(minutes=i))
        for i, (action, flag, *_rest) in enumerate(steps)
    ]
    return spark.createDataFrame(
        rows, "decision_id bigint, audit_id string, flag_id string, action string, note string,"
        " reviewed_by string, ts timestamp"
    )


@pytest.mark.parametrize("n", range(1, 6))
def test_decision_replay(spark, t, n):
    done = decisions.process_decisions(t["audits"], t["flags"], _log(spark, REPLAY[:n]))
    (row,) = done["audits"].collect()
    _action, _flag, score, band, findings, status = REPLAY[n - 1]
    assert (row.audit_id, row.trust_score, row.reviewed_score) == ("AUD-1042", score, score)
    assert (row.risk_band, row.findings_count, row.status) == (band, findings, status)
    assert row.reviewer_decision_count == n
    assert done["history"].count() == n and done["rejected"].count() == 0


def test_rejected_decisions_change_nothing(spark, t):
    """A flag whose audit is unknown stays as it is; a repeated decision counts as first made."""
    orphan = t["flags"].where("flag_id = 'FLG-201'").withColumn("audit_id", F.lit("AUD-9"))
    flags = t["flags"].where("audit_id <> 'AUD-1088'").unionByName(orphan)
    log = _log(spark, [("DISMISS", "FLG-201"), ("DISMISS", "FLG-101"), ("ACCEPT", "FLG-101")])
    log = log.withColumn("audit_id", F.when(F.col("flag_id") == "FLG-201", F.lit("AUD-9")).otherwise(F.col("audit_id")))
    again = log.where("decision_id = 2").withColumn("ts", F.expr("ts + INTERVAL 1 DAY"))
    for every in (log.unionByName(again), again.unionByName(log)):
        done = decisions.process_decisions(t["audits"], flags, every)
        now = {r.flag_id: (r.status, r.decision_count) for r in done["flags"].collect()}
        assert now["FLG-201"] == ("PENDING", 0) and now["FLG-101"] == ("ACCEPTED", 2)
        assert [(r.decision_id, r.reason) for r in done["rejected"].collect()] == [(1, "Audit not found")]
        assert [r.reviewer_decision_count for r in done["audits"].collect()] == [2]
        assert done["history"].count() == 2


def test_progression_follows_the_replay(spark, t):
    rows = scoring.score_progression(t["flags"], _log(spark, REPLAY)).orderBy("step").collect()
    assert [(r.score, r.unresolved_flags) for r in rows] == [(s[2], s[4]) for s in REPLAY]
    peak = scoring.score_peak(scoring.score_progression(t["flags"], _log(spark, REPLAY))).first()
    assert (peak.peak_score, peak.final_score, peak.decisions) == (100, 100, 5)


def test_rescore_differs_from_stored_scores(t):
    rows = {r.audit_id: r for r in scoring.rescore(t["audits"], t["flags"]).collect()}
    assert rows["AUD-1088"].trust_score == 76
    assert rows["AUD-1115"].trust_score == 100 and rows["AUD-1115"].status == "VERIFIED"
    assert all(r.reviewer_decision_count == 1 for r in rows.values())


def test_waterfall(t):
    rows = scoring.waterfall(t["audits"], t["flags"]).where("audit_id = 'AUD-1042'").orderBy("step").collect()
    assert [r.score_after for r in rows] == [100, 72, 58, 48, 42]
    assert [r.final_score for r in rows] == [None, None, None, None, 42]


@pytest.mark.parametrize("impacts,score", [((-80, -90), 0), ((30, 5), 100), ((0,), 100), ((-150, 60), 10)])
def test_clamp_happens_once(spark, impacts, score):
    flags = spark.createDataFrame(
        [("A", i, f"F{i}", "c", "LOW", "PENDING", v) for i, v in enumerate(impacts)], golden.FLAG_SCHEMA
    )
    audits = spark.createDataFrame([("A",)], "audit_id string")
    assert scoring.rescore(audits, flags).first().trust_score == score
    last = scoring.waterfall(audits, flags).where("final_score is not null").collect()
    assert [r.final_score for r in last] == [score]


def test_integrity_report(t):
    rows = {tuple(r) for r in evidence.integrity_report(t["audits"], t["claims"], t["flags"], t["items"]).collect()}
    assert rows == {
        ("FLAG_WITHOUT_CLAIM", "AUD-1088", "FLG-201", "CLM-201"),
        ("ITEM_WITHOUT_FLAG", "AUD-1115", "WTC-301", "FLG-301"),
        ("FINDINGS_COUNT", "AUD-1088", "AUD-1088", "stated 3, actual 1"),
        ("FINDINGS_COUNT", "AUD-1115", "AUD-1115", "stated 2, actual 0"),
    }


def test_passports(spark, t):
    tokens = ["TAMPER-x", "INVALID-x", "unknown-token", "PASSPORT-88219-AUD1042-CRIT",
              "PASSPORT-94102-AUD1104-VERIFIED", "abcd", None, ""]
    asked = spark.createDataFrame([(x,) for x in tokens], "token string")
    verified = passports.verify_passports(asked, t["passports"])
    out = {r.token: (r.valid, r.outcome, r.error_message) for r in verified.collect()}
    assert out["TAMPER-x"] == (False, "TAMPERED", "Document hash mismatch detected")
    assert out["INVALID-x"] == out["unknown-token"] == (False, "INVALID", "Token not found or has expired")
    assert out["abcd"] == out[None] == out[""] == (False, "INVALID", None)
    trail = {}
    for r in passports.verification_trail(verified).orderBy("step_no").collect():
        trail.setdefault(r.token, []).append(r.status)
    assert trail == {
        "TAMPER-x": ["FAIL", "WARN"],
        "PASSPORT-88219-AUD1042-CRIT": ["PASS", "PASS", "PASS", "WARN"],
        "PASSPORT-94102-AUD1104-VERIFIED": ["PASS", "PASS", "PASS", "PASS"],
    }


def test_get_passport_falls_back(spark, t):
    asked = spark.createDataFrame([("aud-1042",), ("AUD-7",)], "audit_id string")
    rows = {r.audit_id: r for r in evidence.get_passport(asked, t["passports"]).collect()}
    assert rows["aud-1042"].token == "PASSPORT-88219-AUD1042-CRIT" and not rows["aud-1042"].is_fallback
    assert rows["AUD-7"].is_fallback and rows["AUD-7"].trust_score == 72


def test_get_audit(t):
    assert audit_source.get_audit(t["audits"], "aud-1042").first().seq == 5
    assert audit_source.get_audit(t["audits"], "nope", strict=False).count() == 0
    with pytest.raises(Exception, match="Audit not found: nope"):
        audit_source.get_audit(t["audits"], "nope").collect()


def test_children_need_their_audit(t):
    rows = audit_source.children_of(t["audits"], t["flags"], "aud-1042").collect()
    assert [r.flag_id for r in rows] == ["FLG-101", "FLG-102", "FLG-103", "FLG-104"]
    orphan = audit_source.children_of(t["audits"].where("seq < 5"), t["flags"], "AUD-1042")
    assert orphan.count() == 0


def test_filters_of_the_workspace(t):
    flags = t["flags"].where("audit_id = 'AUD-1042'")
    assert triage.filter_findings(flags, "HIGH").count() == 2
    assert triage.filter_findings(flags, "ALL").count() == 4
    # every pending flag counts as uncertain
    assert triage.filter_findings(flags, "UNCERTAIN").count() == 4
    assert triage.filter_findings(flags, "UNCERTAIN", strict_uncertain=True).count() == 0


def test_pick_flag(spark, t):
    def picked(selection=None, finding="ALL"):
        chosen = None if selection is None else spark.createDataFrame([selection], "audit_id string, flag_id string")
        rows = triage.pick_flag(t["flags"], chosen, finding).collect()
        return {r.audit_id: r.flag_id for r in rows}["AUD-1042"]

    assert picked() == "FLG-101"
    assert picked(finding="HIGH") == "FLG-102"
    assert picked(finding="LOW") == "FLG-101"
    assert picked(("AUD-1042", "FLG-104"), "HIGH") == "FLG-104"
    assert picked(("AUD-1042", "FLG-999"), "HIGH") == "FLG-102"

"""From documents to verdicts, with passages that state several values."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from veridraft.operators import audit_pipeline as E
from veridraft.store import AuditStore

SOURCES = [
    ("S1", "The licence fee is $6 million a year, the support costs $20 per seat, the deposit was $9 million.", "SIGNED_EXECUTED"),
    ("S2", "Nothing here tells of money at all. Uptime is 99.5% in every month, credits start below 98%.", "DRAFT"),
]
TEXTS = [
    (1, "The licence fee is $5 million a year. The support costs $20 per seat and the deposit was $9 million."),
    (2, "Credits start below 97% of uptime. Unrelated zebra: $1."),
    (3, "The support costs $20 per seat and the deposit was $9 million. It opens on 2026-05-01."),
    (4, "No values."),
]


def verdicts(spark, texts=TEXTS):
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    sources = spark.createDataFrame(SOURCES, "source_key string, text string, authority string").withColumn(
        "freshness_date", F.lit("2026-01-01").cast("date")
    )
    return E.audit_claims(E.document_claims(documents, "doc_id", "text"), sources, "source_key", "text")


def test_each_value_meets_the_one_it_is_about(spark):
    rows = {(r.doc_id, r.value): r for r in verdicts(spark).collect()}
    got = {k: (r.verdict, r.delta_amount, r.source_id) for k, r in rows.items()}
    assert got == {
        (1, "$5 million"): ("CONTRADICTED", -1e6, "S1"),
        (1, "$20"): ("SUPPORTED", 0.0, "S1"), (1, "$9 million"): ("SUPPORTED", 0.0, "S1"),
        (2, "97%"): ("CONTRADICTED", -1.0, "S2"), (2, "$1"): ("UNSUPPORTED", None, None),
        (3, "$20"): ("SUPPORTED", 0.0, "S1"), (3, "$9 million"): ("SUPPORTED", 0.0, "S1"),
        (3, "2026-05-01"): ("UNSUPPORTED", None, None),
    }


def test_no_two_claims_share_a_value(spark):
    """The pair with most words in common is matched first, whatever the order in the text."""
    values = [("k", 1, "A", ["x"]), ("k", 2, "A", ["x", "y", "z"]), ("k", 3, "A", ["x", "y"]), ("k", 4, "B", ["x"]), ("k", 5, "A", ["q"])]
    stated = [("s", 1, 1, "A", ["x", "y", "z"], 10), ("s", 1, 2, "A", ["x", "y"], 20), ("s", 2, 1, "A", ["w"], 30)]
    hits = spark.createDataFrame([("k", "s")], "sentence_key string, source string")
    got = E.aligned_values(
        spark.createDataFrame(values, "sentence_key string, value_no int, category string, context array<string>"), hits,
        spark.createDataFrame(stated, "source string, sentence_no int, value_no int, category string, context array<string>, amount int")
        .withColumns({"kind": F.col("category"), "day": F.lit(None).cast("date")}), "source",
    )
    assert sorted((r.value_no, r.amount) for r in got.collect()) == [(2, 10), (3, 20)]


def test_findings_are_stored_and_decided(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path))
    now = datetime(2026, 10, 9)
    submissions = spark.createDataFrame(
        [(k, f"DOC-{k}", "", "Technical Spec", "English", "a.pdf", "1", now) for k in (1, 2)],
        "seq bigint, audit_id string, title string, document_type string, language string, file_name string, file_size string, ts timestamp",
    )
    files = spark.createDataFrame(
        [("DOC-1", 0, "S1", "po.pdf", "10", None, "h"), ("DOC-2", 0, "S1", "po.pdf", "10", None, "h")],
        "audit_id string, ord int, source_id string, name string, size string, authority string, hash string",
    )
    store.create_audits(submissions, files)
    before = store.flags("DOC-1").collect()
    findings = E.verdict_flags(verdicts(spark), "doc_id", F.concat(F.lit("DOC-"), "doc_id"))
    for _ in range(2):  # the second time adds nothing
        store.record_findings(findings.where("audit_id IN ('DOC-1', 'DOC-2')"))
    flags = store.flags("doc-1").collect()
    assert len(flags) == len(before) + 1
    new = flags[-1]
    assert (new.ord, new.severity, new.impact_score, new.status) == (len(before), "CRITICAL", -10, "PENDING")
    assert new.evidence.source_id == "S1" and new.claim_id == "1-1-1"
    decision = spark.createDataFrame(
        [(1, "doc-1", new.flag_id, "DISMISS", "checked", "r", now)],
        "decision_id bigint, audit_id string, flag_id string, action string, note string, reviewed_by string, ts timestamp",
    )
    assert store.submit_decisions(decision).count() == 0
    assert [f.status for f in store.flags("DOC-1").collect()][-1] == "DISMISSED"
    assert store.audit("DOC-1").first().findings_count == len(before)

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veridraft import domains as D
from veridraft.functions import scores, texts
from veridraft.operators import decisions, verdicts
from veridraft.sources import uploads


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", _i int")
    return [r[0] for r in df.select(column.alias("x"), "_i").orderBy("_i").select("x").collect()]


def test_bands_and_clamp(spark):
    assert values(spark, [(x,) for x in (100, 80, 79, 50, 49, 0, None)], "s int", scores.risk_band(F.col("s"))) == [
        "Trustworthy", "Trustworthy", "Review Needed", "Review Needed", "High Risk", "High Risk", None
    ]
    assert values(spark, [(x,) for x in (-5, 105, 7, None)], "s int", scores.clamp_score(F.col("s"))) == [0, 100, 7, 0]


def test_effective_score(spark):
    rows = [("PROCESSING", 50, 60), ("VERIFIED", 50, None), ("VERIFIED", 50, 0)]
    column = scores.effective_score(F.col("st"), F.col("t"), F.col("r"))
    assert values(spark, rows, "st string, t int, r int", column) == [None, 50, 0]


def test_labels_keep_their_quirks(spark):
    column = scores.label_of(F.col("x"), "severity")
    assert values(spark, [("INFORMATIONAL",), ("?",), (None,), ("HIGH",)], "x string", column) == ["LOW", "LOW", "LOW", "HIGH"]
    column = scores.label_of(F.col("x"), "result_state")
    assert values(spark, [("FAILED",), ("READY",)], "x string", column) == ["Verification Running", "Material Conflicts Detected"]
    assert values(spark, [("Commercial",), ("MATERIAL",), ("MODERATE",), (None,)], "x string", scores.materiality_tier(F.col("x"))) == [
        "slate", "red", "amber", "slate"
    ]


def test_title_or_stem(spark):
    rows = [("T", "a.pdf"), ("", "a.tar.gz"), (None, "noext"), (None, "dir.v1/file"), (None, ".hidden")]
    column = texts.title_or_stem(F.col("t"), F.col("n"))
    assert values(spark, rows, "t string, n string", column) == ["T", "a.tar", "noext", "dir.v1/file", ""]


def test_source_type_is_case_sensitive(spark):
    assert values(spark, [("a.pdf",), ("a.PDF",), ("b.xlsx",), ("c",)], "n string", texts.source_type(F.col("n"))) == [
        "Purchase Order", "Policy Doc", "Commercial Schedule", "Policy Doc"
    ]


def test_authority_and_size_defaults(spark):
    column = texts.default_authority(F.col("a"), F.col("o"))
    assert values(spark, [(None, 0), ("", 1), ("DRAFT", 0)], "a string, o int", column) == [
        "LATEST_APPROVED", "SIGNED_EXECUTED", "DRAFT"
    ]
    assert values(spark, [("12",), ("2.4 MB",), (None,)], "s string", texts.size_or_default(F.col("s"))) == [
        12, D.DEFAULT_SIZE_BYTES, D.DEFAULT_SIZE_BYTES
    ]
    assert values(spark, [("1048576",), ("2.4 MB",)], "s string", texts.format_size_text(F.col("s"))) == ["1.0 MB", "2.4 MB"]


def test_upload_validation(spark):
    limit = D.UPLOAD_LIMIT_BYTES
    files = spark.createDataFrame(
        [("A.PDF", limit, 1), ("b.pdf", limit + 1, 1), ("c.exe", limit + 1, 1), ("d.txt", 0, 1), ("e", 1, 3)],
        "name string, size_bytes bigint, batch_size int",
    )
    accepted, rejected = uploads.validate_uploads(files)
    assert {r.name for r in accepted.collect()} == {"A.PDF", "d.txt"}
    assert {r.name: r.reason for r in rejected.collect()} == {
        "b.pdf": D.TOO_LARGE, "c.exe": D.BAD_EXTENSION, "e": D.BAD_EXTENSION
    }
    accepted, _ = uploads.validate_uploads(files, validate_multi=False)
    assert "e" in {r.name for r in accepted.collect()}


def test_manifest_has_real_digests(spark, tmp_path):
    import hashlib

    for name, content in (("a.txt", b"hello"), ("b.bin", b"x"), ("c.txt", b"")):
        (tmp_path / name).write_bytes(content)
    files = spark.createDataFrame([(f"file:{p}", p.stat().st_size) for p in tmp_path.iterdir()] + [("file:/gone.txt", 9)], "path string, length bigint")
    contents = uploads.read_contents(spark, str(tmp_path))
    rows = {r.filename: r for r in uploads.upload_manifest(files, contents, {"txt": "text/plain"}).collect()}
    assert len(rows) == 4 and rows["gone.txt"].hash is None
    assert rows["a.txt"].hash == "sha256:" + hashlib.sha256(b"hello").hexdigest()
    assert rows["c.txt"].hash == "sha256:" + hashlib.sha256(b"").hexdigest() and rows["c.txt"].size_bytes == 0
    assert (rows["a.txt"].size_bytes, rows["a.txt"].mime_type) == (5, "text/plain")
    assert rows["b.bin"].mime_type == "application/octet-stream"


def test_source_edits(spark):
    sources = spark.createDataFrame([("1", "a", "DRAFT", 1), ("2", "b", "DRAFT", 2)], "source_id string, name string, authority string, size_bytes bigint")
    edits = spark.createDataFrame(
        [("ADD", "3", "c", None, 3), ("REMOVE", "1", None, None, None), ("AUTHORITY", "2", None, "SUPERSEDED", None)],
        "op string, source_id string, name string, authority string, size_bytes bigint",
    )
    rows = {tuple(r) for r in uploads.apply_source_edits(sources, edits).collect()}
    assert rows == {("2", "b", "SUPERSEDED", 2), ("3", "c", "LATEST_APPROVED", 3)}


def test_locations(spark):
    rows = [("pdf",), ("xlsx",), ("docx",), ("text",), ("unknown",), (None,)]
    location = F.struct(
        F.col("t").alias("type"), F.lit(3).alias("page"), F.lit(2).alias("paragraph"), F.lit(1).alias("char_start"),
        F.lit(9).alias("char_end"), F.lit("S").alias("sheet"), F.lit("B4").alias("cell"),
    )
    assert values(spark, rows, "t string", texts.format_location(location)) == [
        "Page 3", "Sheet S!B4", "Para 2 (1-9)", "chars 1..9", None, None
    ]


def test_dates_and_ranks(spark):
    rows = [("2026-10-08T17:42:00Z",), ("soon",), (None,)]
    assert values(spark, rows, "x string", texts.format_timestamp(F.col("x"))) == ["08 Oct, 17:42", "soon", None]
    assert values(spark, rows, "x string", texts.format_timestamp(F.col("x"), False)) == ["08 Oct 2026", "soon", None]
    assert values(spark, [(1,), (10,), (123,)], "x int", texts.rank_text(F.col("x"))) == ["01", "10", "123"]


@pytest.mark.parametrize("text,needle,expected", [
    ("a b a", "a", "b a"), ("xay", "a", "xy"), ("abc", "z", "abc"), ("  abc ", "", "abc"),
    ("A a", "a", "A"), (" x\n", "q", "x"), ("a.c abc", "a.c", "abc"),
])
def test_without_first(spark, text, needle, expected):
    assert values(spark, [(text, needle)], "t string, n string", texts.without_first(F.col("t"), F.col("n"))) == [expected]


def test_split_paragraphs(spark):
    rows = [("a\n\nb\n\n\n\nc",), ("",), (" \n\n ",), (None,)]
    got = values(spark, rows, "t string", texts.split_paragraphs(F.col("t")))
    assert got == [["a", "b", "c"], [], [" ", " "], None]


LOG = "decision_id bigint, audit_id string, flag_id string, action string, note string, reviewed_by string, ts timestamp"


def _apply(spark, steps):
    from datetime import datetime, timedelta

    start = datetime(2026, 1, 1)
    log = spark.createDataFrame(
        [(i, "A", "F", a, n, "r", start + timedelta(seconds=s)) for i, (a, n, s) in enumerate(steps)], LOG
    )
    flags = spark.createDataFrame([("a", "F", "PENDING", "old", -1)], "audit_id string, flag_id string, status string, reviewer_note string, impact_score int")
    row = decisions.apply_decisions(flags, log).first()
    return row.status, row.reviewer_note, row.decision_count


def test_last_decision_wins(spark):
    assert _apply(spark, [("ACCEPT", "n", 0)]) == ("ACCEPTED", "old", 1)
    assert _apply(spark, [("FIX", "", 0)]) == ("FIXED", "Applied suggested fix", 1)
    assert _apply(spark, [("FIX", "x", 0), ("DISMISS", None, 1)]) == ("DISMISSED", None, 2)
    assert _apply(spark, [("DISMISS", "y", 5), ("ACCEPT", "z", 9)]) == ("ACCEPTED", "y", 2)
    # arrival order does not matter; ids break ties; unknown actions only count
    assert _apply(spark, [("DISMISS", "y", 9), ("FIX", "x", 1)]) == ("DISMISSED", "y", 2)
    assert _apply(spark, [("ACCEPT", None, 3), ("DISMISS", "t", 3)]) == ("DISMISSED", "t", 2)
    assert _apply(spark, [("ESCALATE", "q", 3)]) == ("PENDING", "old", 1)


def test_split_decisions_is_total(spark):
    from datetime import datetime

    now = datetime(2026, 1, 1)
    log = spark.createDataFrame(
        [(1, "a", "F", "ACCEPT", None, "r", now), (2, "A", "f", "ACCEPT", None, "r", now), (3, "B", "F", "FIX", None, "r", now)], LOG
    )
    flags = spark.createDataFrame([("A", "F")], "audit_id string, flag_id string")
    ok, rejected = decisions.split_decisions(log, spark.createDataFrame([("A",)], "audit_id string"), flags)
    assert [r.decision_id for r in ok.collect()] == [1]
    assert {r.decision_id: r.reason for r in rejected.collect()} == {2: "Flag not found", 3: "Audit not found"}


def test_notes_and_edits(spark):
    from datetime import datetime

    now = datetime(2026, 1, 1)
    rows = [(1, "a", "F", "DISMISS", " ", "r", now, False), (2, "a", "F", "DISMISS", "x", "r", now, False),
            (3, "a", "F", "FIX", None, "r", now, True), (4, "a", "F", "FIX", None, "r", now, False), (5, "a", "F", "ACCEPT", None, "r", now, False)]
    valid, invalid = decisions.validate_notes(spark.createDataFrame(rows, LOG + ", is_edit boolean"))
    assert {r.decision_id for r in valid.collect()} == {2, 4, 5}
    assert {r.decision_id for r in invalid.collect()} == {1, 3}


def test_parse_values(spark):
    rows = [("₹20,640,000",), ("24.8M",), ("99.5 %",), ("none",), ("₹41.6L",)]
    got = values(spark, rows, "x string", verdicts.parse_amount(F.col("x")))
    assert got == [20640000, 24800000, Decimal("99.5"), None, 4160000]
    rows = [("16.4M",), ("₹2.5 Cr",), ("₹15 lakh",), ("$5 million",), ("20 Meters",), ("5 Basis",), ("1.29M",), ("9" * 25,)]
    got = values(spark, rows, "x string", verdicts.parse_amount(F.col("x")))
    assert got == [16400000, 25000000, 1500000, 5000000, 20, 5, 1290000, None]
    forms = [("22 Dec 2026",), ("2026-11-15",), ("x",), ("March 5, 2026",), ("Dec 22, 2026",), ("7 November 2026",)]
    days = values(spark, forms, "x string", verdicts.parse_day(F.col("x")))
    assert [str(d) if d else None for d in days] == [
        "2026-12-22", "2026-11-15", None, "2026-03-05", "2026-12-22", "2026-11-07"
    ]


def test_verdicts(spark):
    schema = "id int, kind string, text string"
    def typed(rows):
        df = spark.createDataFrame(rows, schema)
        return df.select(
            "id", "kind", F.when(F.col("kind") == "AMOUNT", verdicts.parse_amount(F.col("text"))).alias("amount"),
            F.when(F.col("kind") == "DATE", verdicts.parse_day(F.col("text"))).alias("day"),
        )

    claims = typed([(1, "DATE", "22 Dec 2026"), (2, "AMOUNT", "₹24,800,000"), (3, "AMOUNT", "5"), (4, "AMOUNT", "7"), (5, "AMOUNT", "x")])
    truths = typed([(1, "DATE", "15 Nov 2026"), (2, "AMOUNT", "₹20,640,000"), (4, "AMOUNT", "7.0"), (5, "AMOUNT", "1")])
    rows = {r.id: r for r in verdicts.claim_verdicts(claims, truths, ["id"]).collect()}
    assert (rows[1].verdict, rows[1].delta_days) == ("CONTRADICTED", 37)
    assert (rows[2].verdict, rows[2].delta_amount) == ("CONTRADICTED", 4160000.0)
    assert [rows[i].verdict for i in (3, 4, 5)] == ["UNSUPPORTED", "SUPPORTED", "UNCERTAIN"]

"""Golden audits: small tables with known results. Numbers and ids are fixed values."""

from __future__ import annotations

# seq, audit_id, title, document_name, status, priority, trust, reviewed, findings_count
AUDITS = [
    (5, "AUD-1042", "Cloud procurement agreement", "procurement_v3.pdf", "REVIEW REQUIRED", "CRITICAL", 42, None, 4),
    (4, "AUD-1088", "Vendor indemnity agreement", "indemnity_v1.pdf", "REVIEW REQUIRED", "HIGH", 58, None, 3),
    (3, "AUD-1104", "Quarterly filing", "filing_q3.pdf", "VERIFIED", "LOW", 94, 94, 0),
    (2, "AUD-1115", "API security specification", "api_spec_v2.pdf", "REVIEW REQUIRED", "HIGH", 71, None, 2),
    (1, "AUD-1120", "Data residency protocol", "residency.docx", "PROCESSING", "HIGH", 0, None, 0),
]
AUDIT_SCHEMA = (
    "seq bigint, audit_id string, title string, document_name string, status string, priority string,"
    " trust_score int, reviewed_score int, findings_count int"
)
# audit_id, ord, flag_id, claim_id, severity, status, impact
FLAGS = [
    ("AUD-1042", 0, "FLG-101", "CLM-01", "CRITICAL", "PENDING", -28),
    ("AUD-1042", 1, "FLG-102", "CLM-02", "HIGH", "PENDING", -14),
    ("AUD-1042", 2, "FLG-103", "CLM-03", "HIGH", "PENDING", -10),
    ("AUD-1042", 3, "FLG-104", "CLM-04", "CRITICAL", "PENDING", -6),
    ("AUD-1088", 0, "FLG-201", "CLM-201", "HIGH", "PENDING", -24),
]
FLAG_SCHEMA = (
    "audit_id string, ord int, flag_id string, claim_id string, severity string, status string, impact_score int"
)
CLAIMS = [("AUD-1042", f"CLM-0{i}", i) for i in range(1, 5)]
SOURCES = [("AUD-1042", i, f"SRC-00{i + 1}") for i in range(4)] + [
    ("AUD-1088", 0, "SRC-010"), ("AUD-1104", 0, "SRC-030"), ("AUD-1115", 0, "SRC-040"),
]
ITEMS = [("AUD-1042", f"WTC-0{i}", f"FLG-10{i}") for i in range(1, 5)] + [
    ("AUD-1088", "WTC-201", "FLG-201"), ("AUD-1115", "WTC-301", "FLG-301"),
]
PASSPORTS = [
    ("PASSPORT-88219-AUD1042-CRIT", 0, "AUD-1042", 42, 4),
    ("PASSPORT-94102-AUD1104-VERIFIED", 1, "AUD-1104", 94, 0),
]


def tables(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return {
        "audits": make(AUDITS, AUDIT_SCHEMA),
        "flags": make(FLAGS, FLAG_SCHEMA).selectExpr("*", "CAST(NULL AS STRING) AS reviewer_note"),
        "claims": make(CLAIMS, "audit_id string, claim_id string, claim_number int"),
        "sources": make(SOURCES, "audit_id string, ord int, source_id string"),
        "items": make(ITEMS, "audit_id string, item_id string, flag_id string"),
        "passports": make(
            PASSPORTS, "token string, ord int, audit_id string, trust_score int, unresolved_flags_count int"
        ),
    }

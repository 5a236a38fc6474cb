"""Table schemas (Spark DDL). Arrays of the nested audit object are child tables
keyed by ``audit_id``; ``ord`` is the 0-based array position, ``seq`` the
insertion order of audits (higher = newer)."""

from __future__ import annotations

LOCATION = (
    "STRUCT<type STRING, page INT, bbox ARRAY<DOUBLE>, paragraph INT, char_start INT,"
    " char_end INT, sheet STRING, cell STRING, description STRING>"
)

#: ``audit_key`` is the audit id in lower case, stored so that scans can be pruned by it.
AUDITS = (
    "seq BIGINT, audit_key STRING, audit_id STRING, title STRING, document_name STRING, document_version STRING,"
    " document_type STRING, language STRING, uploaded_at TIMESTAMP, updated_at TIMESTAMP,"
    " status STRING, processing_status STRING, result_state STRING, priority STRING,"
    " trust_score INT, initial_score INT, risk_band STRING, reviewed_score INT,"
    " reviewed_risk_band STRING, reviewer_decision_count BIGINT, findings_count BIGINT,"
    " passport_token STRING,"
    " ai_document STRUCT<name STRING, version STRING, size STRING, hash STRING,"
    " page_count INT, raw_text STRING>,"
    " result_summary STRUCT<claims_checked BIGINT, evidence_matched BIGINT, contradictions BIGINT,"
    " unsupported_claims BIGINT, uncertain_claims BIGINT, critical_findings BIGINT, high_findings BIGINT,"
    " medium_findings BIGINT, low_findings BIGINT, result_state STRING>"
)

FLAGS = (
    "audit_key STRING, audit_id STRING, ord INT, flag_id STRING, claim_id STRING, type STRING, severity STRING,"
    " materiality STRING, claim STRING, reason STRING, suggested_fix STRING, what_to_check STRING,"
    " status STRING, reviewer_note STRING, impact_score INT, verification_status STRING,"
    " evidence STRUCT<source_id STRING, source_name STRING, authority STRING,"
    f" freshness_date STRING, quote STRING, location STRING, document_location {LOCATION},"
    " relevance_score DOUBLE, relationship STRING>,"
    " counter_evidence STRUCT<source_name STRING, quote STRING, location STRING,"
    f" document_location {LOCATION}>,"
    " materiality_detail STRUCT<category STRING, impact_rationale STRING,"
    " financial_exposure STRING, legal_exposure STRING, is_provisional BOOLEAN,"
    " methodology_version STRING>,"
    " policy_findings ARRAY<STRUCT<policy_name STRING, policy_status STRING, rationale STRING,"
    " consequence STRING, relevant_clause STRING>>,"
    " omission_findings ARRAY<STRUCT<description STRING, related_section STRING,"
    " why_it_matters STRING, confidence STRING, requires_human_review BOOLEAN>>"
)

CLAIMS = (
    "audit_key STRING, audit_id STRING, claim_id STRING, claim_number INT, text STRING, category STRING,"
    f" status STRING, document_location {LOCATION}, expected_truth STRING, variance STRING"
)

SOURCE_DOCUMENTS = (
    "audit_key STRING, audit_id STRING, ord INT, source_id STRING, name STRING, type STRING, size_bytes BIGINT,"
    " uploaded_at TIMESTAMP, authority STRING, authority_label STRING, freshness_date DATE,"
    " version STRING, approval_status STRING, modified_date STRING, hash STRING"
)

CHECK_ITEMS = (
    "audit_key STRING, audit_id STRING, ord INT, item_id STRING, `order` INT, title STRING, severity STRING,"
    " materiality STRING, flag_id STRING, summary STRING, action_required STRING"
)

WATERFALL = (
    "audit_key STRING, audit_id STRING, ord INT, name STRING, deduction INT, score_after BIGINT, description STRING,"
    " severity STRING"
)

DECISIONS = (
    "decision_id BIGINT, audit_id STRING, flag_id STRING, action STRING, note STRING,"
    " reviewed_by STRING, ts TIMESTAMP"
)

PASSPORTS = (
    "token STRING, ord INT, audit_id STRING, document_name STRING, document_hash STRING,"
    " claim_tree_root STRING, signature STRING, signed_by STRING, signed_at TIMESTAMP,"
    " trust_score INT, reviewed_score INT, reviewed_risk_band STRING, status STRING,"
    " total_claims_checked BIGINT, verified_claims_count BIGINT, unresolved_flags_count BIGINT"
)

STAGE_EVENTS = "audit_id STRING, status STRING, ts TIMESTAMP"

TABLES = {
    "audits": AUDITS,
    "flags": FLAGS,
    "claims": CLAIMS,
    "source_documents": SOURCE_DOCUMENTS,
    "check_items": CHECK_ITEMS,
    "waterfall": WATERFALL,
    "decisions": DECISIONS,
    "passports": PASSPORTS,
    "stage_events": STAGE_EVENTS,
}

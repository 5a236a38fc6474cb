"""Closed domains, ranks, labels, thresholds and texts.

Everything in this file is a constant that results must reproduce exactly.
"""

from __future__ import annotations

# --- fixed values: severities, in rank order --------------------------------
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFORMATIONAL": 4}
UNKNOWN_RANK = 99

# --- fixed values: score bands ------------------------------------------------
BASELINE_SCORE = 100
TRUSTWORTHY_FROM = 80
REVIEW_FROM = 50
BAND_TRUSTWORTHY = "Trustworthy"
BAND_REVIEW = "Review Needed"
BAND_HIGH_RISK = "High Risk"

# --- fixed values: status domains ---------------------------------------------
ACTIVE_FLAG_STATUSES = ("PENDING", "ACCEPTED")
DONE_AUDIT_STATUSES = ("COMPLETED", "REVIEW REQUIRED", "VERIFIED")
ACTION_STATUS = {"ACCEPT": "ACCEPTED", "DISMISS": "DISMISSED", "FIX": "FIXED"}
DEFAULT_FIX_NOTE = "Applied suggested fix"

# --- fixed values: labels by domain; None = the label of any other value --------
LABELS = {
    "flag_status": {
        "ACCEPTED": "Confirmed Risk",
        "DISMISSED": "Dismissed",
        "FIXED": "Remediated",
        None: "Review Required",
    },
    "result_state": {
        "READY": "Material Conflicts Detected",
        "FINDINGS_PRESENT": "Material Conflicts Detected",
        "NO_FINDINGS": "100% Ground Truth Confirmed",
        "UNCERTAIN": "Inconclusive / Reviewer Verification Needed",
        "PARTIAL": "Partial Ingestion Completed",
        None: "Verification Running",
    },
    "audit_status": {
        "VERIFIED": "VERIFIED",
        "REVIEW REQUIRED": "REVIEW REQUIRED",
        "PROCESSING": "PROCESSING",
        "QUEUED": "QUEUED",
        "FAILED": "FAILED",
        "TAMPER DETECTED": "TAMPER DETECTED",
        None: "COMPLETED",
    },
    "severity": {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "MEDIUM": "MEDIUM", None: "LOW"},
    "verdict": {
        "CONTRADICTED": "CONTRADICTED BY GROUND TRUTH",
        "UNSUPPORTED": "UNSUPPORTED (NO GROUND TRUTH FOUND)",
        "UNCERTAIN": "UNCERTAIN / INCONCLUSIVE EVIDENCE",
        "SUPPORTED": "SUPPORTED BY AUTHORITATIVE SOURCE",
        None: "REVIEW REQUIRED",
    },
    "authority_card": {
        "LATEST_APPROVED": "✓ Latest Approved",
        "SIGNED_EXECUTED": "✓ Signed & Executed",
        "SUPERSEDED": "Older / Superseded",
        "DRAFT": "Preliminary Draft",
    },
    "authority_file": {
        "LATEST_APPROVED": "Latest Approved Document",
        None: "Signed Execution File",
    },
    "score_state": {
        "calculating": "Score Calculating",
        "failed": "Score Evaluation Failed",
        "unavailable": "Score Unavailable",
    },
    "heatmap": {
        "CLEAN": "Clean",
        "CRITICAL": "Critical Risk",
        "HIGH": "High Variance",
        "MEDIUM": "Review Needed",
        None: "Low",
    },
    "feedback": {
        "ACCEPT": "Finding accepted. Risk confirmed on audit record.",
        "FIX": "Marked as fixed. Trust score recalibrated.",
        None: "Finding dismissed with documented rationale.",
    },
    "policy_tier": {
        "VIOLATED": "red",
        "AT_RISK": "amber",
        "COMPLIANT": "emerald",
        None: "slate",
    },
}

# --- fixed values: materiality words by tier ------------------------------------
RED_MATERIALITY = ("MATERIAL", "CRITICAL", "Regulatory")
AMBER_MATERIALITY = ("HIGH", "MODERATE", "Operational")

# --- fixed values: source precedence (best first) -------------------------------
AUTHORITY_ORDER = ("LATEST_APPROVED", "SIGNED_EXECUTED", "DRAFT", "SUPERSEDED")

# --- fixed values: uploads --------------------------------------------------------
UPLOAD_EXTENSIONS = (".pdf", ".docx", ".xlsx", ".xls", ".txt")
UPLOAD_LIMIT_BYTES = 50 * 1024 * 1024
DEFAULT_SIZE_BYTES = 1240000
DEFAULT_MIME = "application/octet-stream"
BAD_EXTENSION = "Unsupported file format. Please upload PDF, DOCX, XLSX, or TXT."
TOO_LARGE = "File size exceeds the 50MB limit."
EXTENSION_PATTERN = r"\.[^/.]+$"

# --- fixed values: shown processing stages, in order ------------------------------
SHOWN_STAGES = (
    ("UPLOADING", "Receiving documents & calculating SHA-256 hashes"),
    ("PARSING", "Parsing files & extracting raw content"),
    ("CANONICALIZING", "Building canonical text stream"),
    ("EXTRACTING_FACTS", "Extracting verifiable business claims"),
    ("INDEXING", "Preparing evidence retrieval index (BM25 + BGE-M3)"),
    ("VERIFYING", "Running deterministic trust verification"),
)
ALL_STAGES = (
    "QUEUED", "UPLOADING", "PARSING", "CANONICALIZING", "EXTRACTING_FACTS",
    "INDEXING", "RETRIEVING", "VERIFYING", "COMPLETED",
)

# --- fixed values: passports --------------------------------------------------------
MIN_TOKEN_LENGTH = 5
TAMPER_PREFIX = "TAMPER-"
INVALID_PREFIX = "INVALID-"
TAMPER_MESSAGE = "Document hash mismatch detected"
INVALID_MESSAGE = "Token not found or has expired"
TRAIL_TAMPERED = (
    ("Document SHA-256 Digest Validation", "FAIL", "Hash mismatch detected"),
    ("Claim Hash Chain Inclusion Proof", "WARN", "Unable to verify"),
)
TRAIL_VERIFIED = (
    ("Document SHA-256 Digest Validation", "PASS", "Hash matches cryptographic manifest"),
    ("Claim Hash Chain Inclusion Proof", "PASS", "Claim digests verified in sequence"),
    (
        "ECDSA P-256 Validator Signature Verification",
        "PASS",
        "ECDSA P-256 / prime256v1 key signature confirmed",
    ),
)
RECONCILIATION_STEP = "Fact Reconciliation Anchor"
RECONCILIATION_DETAIL = " unaddressed commercial/date variances logged"
STANDIN_PASSPORT = {
    "document_name": "AI_Verified_Document.pdf",
    "trust_score": 72,
    "status": "VERIFIED",
    "total_claims_checked": 8,
    "verified_claims_count": 7,
    "unresolved_flags_count": 1,
}

# --- fixed values: what a newly created audit starts with --------------------------
NEW_AUDIT = {
    "status": "PROCESSING",
    "processing_status": "COMPLETED",
    "priority": "HIGH",
    "trust_score": 72,
    "initial_score": 100,
    "risk_band": "Review Needed",
    "findings_count": 1,
    "document_size": "1.8 MB",
    "page_count": 5,
    "raw_text": (
        "AI SYNTHESIZED DOCUMENT CONTENT:\n\n"
        "1. Commercial consideration agreed is ₹18,500,000.\n"
        "2. Delivery milestone due in 12 months from execution."
    ),
    "claim_text": "Commercial consideration agreed is ₹18,500,000.",
    "claim_category": "COMMERCIAL_VALUE",
    "claim_status": "CONTRADICTED",
    "expected_truth": "₹15,000,000 in approved vendor budget",
    "variance": "+₹3,500,000 unapproved variation",
    "flag_type": "Budget Discrepancy",
    "flag_severity": "HIGH",
    "flag_materiality": "HIGH",
    "flag_reason": "Variance against approved procurement ceiling.",
    "flag_status": "PENDING",
    "flag_impact": -28,
    "suggested_fix": "Reconcile total to ₹15,000,000.",
    "what_to_check": "Confirm ceiling with procurement lead",
    "evidence_source_id": "SRC-1",
    "evidence_source_name": "Approved Budget",
    "evidence_authority": "Latest Approved File",
    "evidence_freshness": "Recent",
    "evidence_quote": '"Approved budget ceiling is ₹15,000,000 INR."',
    "evidence_location": "Section 2 · Page 3",
    "check_title": "Confirm procurement cap against approved source",
    "check_summary": "Variance of ₹3.5M detected between AI summary and approved budget file.",
    "check_action": "Verify Item 2 in source document.",
    "waterfall": (
        ("Initial Trust Baseline", 0, 100, "Baseline", "NEUTRAL"),
        (
            "Commercial Ceiling Variance", -28, 72,
            "Discrepancy against approved file", "HIGH",
        ),
    ),
    "source_version": "v1.0",
}

# --- fixed values: text handling ----------------------------------------------------
CLAIM_PREFIX_CHARS = 30
DYNAMIC_TEXT_MARKER = "AI SYNTHESIZED"
HEATMAP_SECTIONS = 5
CLAIMS_FALLBACK = 4
DEFAULT_SUMMARY_VERSION = "v3.2"
DEFAULT_EVIDENCE_AUTHORITY = "Approved Source"
DEFAULT_FRESHNESS = "Current"
STAGE_AWAITING = "Awaiting Human Auditor Sign-off"
STAGE_DONE = "Analysis complete"

"""Schemas of the screening tables and of the nested report."""

FIELD = "STRUCT<name: STRING, value: STRING, confidence: DOUBLE, flagged: BOOLEAN, source: STRING, check_digit_ok: BOOLEAN, notes: ARRAY<STRING>>"
INDICATOR = "STRUCT<type: STRING, severity: STRING, confidence: DOUBLE, note: STRING>"
CHECK = "STRUCT<field: STRING, status: STRING, message: STRING, rule: STRING>"

USERS = "id BIGINT, username STRING, password_hash STRING, role STRING, is_active BOOLEAN, failed_login_count INT, locked_until TIMESTAMP, must_change_password BOOLEAN, created_at TIMESTAMP"
SCREENINGS = (
    "id BIGINT, run_id STRING, operator_id BIGINT, original_path STRING, probe_image_path STRING, file_sha256 STRING, doc_type_hint STRING, "
    "doc_type_detected STRING, status STRING, risk_score DOUBLE, risk_band STRING, human_review_required BOOLEAN, report_json STRING, "
    "report_encrypted BOOLEAN, pdf_pages INT, created_at TIMESTAMP, completed_at TIMESTAMP"
)
REVIEWS = "id BIGINT, screening_id BIGINT, reviewer_id BIGINT, decision STRING, notes STRING, decided_at TIMESTAMP"
AUDIT_EVENTS = "id BIGINT, screening_id BIGINT, event_type STRING, payload_sha256 STRING, chain STRING, tx_hash STRING, block_number BIGINT, anchor_status STRING, created_at TIMESTAMP"
REGISTRY = "id BIGINT, is_mock BOOLEAN, doc_type STRING, doc_number STRING, full_name STRING, date_of_birth STRING, expiry_date STRING, status STRING, created_at TIMESTAMP"
LEDGER = "ledger STRING, sequence BIGINT, screening_id STRING, record STRING, prev_entry_hash STRING, entry_hash STRING"

# The closed vocabularies of the data model.
DOC_TYPES = ("passport", "visa", "national_id", "driving_license", "permit", "unknown")
RISK_BANDS = ("low", "medium", "high", "critical")
STATUSES = ("processing", "pending_review", "reviewed")
DECISIONS = ("cleared", "flagged", "escalated", "inconclusive")
ROLES = ("ADMIN", "SECURITY_OFFICER", "REVIEWER")
EVENT_TYPES = ("screening_completed", "audit_logged", "review_decided")

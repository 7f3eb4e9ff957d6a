"""Schemas of the tables. Files are always read with these, never with inference."""

from __future__ import annotations

COLLEGES = (
    "college_id string, college_code string, college_name string, original_name string, "
    "location string, address string, institution_type string"
)
COLLEGE_ALIASES = "college_id string, alias string, source string"
BRANCHES = (
    "branch_id string, branch_code string, branch_name string, original_name string, "
    "program_type string, is_canonical boolean, canonical_branch_id string"
)
COLLEGE_BRANCHES = (
    "college_id string, branch_id string, source_version_id string, course_code string, "
    "academic_year int, is_active boolean"
)
CATEGORIES = "category_code string, category_name string, description string"
ROUNDS = (
    "academic_year int, round_code string, round_name string, round_number int, "
    "is_general_round boolean"
)
CUTOFFS = (
    "record_id string, source_version_id string, college_id string, branch_id string, "
    "category_code string, round_code string, academic_year int, opening_rank int, "
    "closing_rank int, page_number int, row_identifier string, status string"
)
SEATS = (
    "record_id string, source_version_id string, college_id string, branch_id string, "
    "category_code string, round_code string, academic_year int, total_seats int, "
    "vacant_seats int, status string, created_at timestamp"
)
FEES = (
    "record_id string, source_version_id string, college_id string, branch_id string, "
    "academic_year int, total_fee decimal(12,2), tuition_fee decimal(12,2), "
    "other_fee decimal(12,2), currency string, status string"
)
SOURCES = (
    "source_id string, source_code string, title string, url string, document_type string, "
    "academic_year int, authority_level string, is_enabled boolean, check_frequency_hours int, "
    "last_checked_at timestamp, last_success_at timestamp, last_seen_hash string, "
    "parser_version string"
)
SOURCE_VERSIONS = (
    "source_version_id string, source_id string, source_title string, source_url string, "
    "document_type string, content_hash string, file_size bigint, academic_year int, "
    "processing_status string, created_at timestamp"
)
RUNS = (
    "run_id string, started_at timestamp, finished_at timestamp, status string, source_count int, "
    "published_count int, rejected_count int, validation_error_count int, anomaly_count int, "
    "needs_review_count int"
)
VALIDATION_ERRORS = (
    "run_id string, source_version_id string, entity_type string, entity_identifier string, "
    "error_code string, message string, context_data string, severity string"
)
REVIEW_ITEMS = (
    "item_id string, source_id string, source_version_id string, document_type string, "
    "document_url string, failure_reason string, validation_errors string, status string, "
    "reviewed_by string, review_notes string, created_at timestamp"
)
REQUESTS = (
    "request_id string, college_id string, branch_id string, academic_year int, round string, "
    "category string, program_type string, model_type string, candidate_rank int"
)
GRIDS = (
    "doc_id string, page int, table_no int, header array<string>, row_no int, cells array<string>, "
    "document_type string, title string, academic_year int"
)
RAW_CUTOFFS = (
    "row_idx bigint, college_code string, branch_code string, category_code string, "
    "round_code string, opening_rank int, closing_rank int, academic_year int, row_identifier string"
)
RAW_SEATS = (
    "row_idx bigint, college_code string, branch_code string, counselling_round string, "
    "category_code string, academic_year int, total_seats int, vacant_seats int, gm_seats int, "
    "kkr_seats int, row_identifier string"
)
RAW_FEES = (
    "row_idx bigint, college_code string, branch_code string, academic_year int, total_fee string, "
    "tuition_fee string, other_fee string, row_identifier string"
)

# the business key of a cutoff
CUTOFF_KEY = ["college_id", "branch_id", "category_code", "round_code", "academic_year"]

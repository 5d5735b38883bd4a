"""Declared schemas of the engine's tables."""

from __future__ import annotations

# Readers take these DDL strings as they are.
TABLES: dict[str, str] = {
    "roles": "role_id string, name string, permissions array<string>",
    "departments": "department_id string, name string, code string",
    "users": "user_id string, email string, full_name string, role string, department_id string, is_active boolean",
    "collections": "collection_id string, department_id string, owner_user_id string, name string, slug string, "
                   "is_private boolean, is_active boolean, created_at timestamp_ntz",
    "documents": "document_id string, collection_id string, scheme_name string, department string, "
                 "state_or_district string, language string, publication_date timestamp_ntz, "
                 "effective_date timestamp_ntz, original_filename string, storage_file_key string, mime_type string, "
                 "file_hash string, version_number int, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "versions": "version_id string, document_id string, version_number int, file_hash string, file_size_bytes bigint, "
                "total_pages int, status string, effective_date timestamp_ntz, change_summary string, error_message string",
    "pages": "version_id string, document_id string, page_number int, raw_text string, native_text string, "
             "ocr_text string, extraction_method string, ocr_confidence double, is_scanned boolean, "
             "requires_admin_review boolean, review_reason string, word_count int",
    "chunks": "vector_id string, version_id string, document_id string, page_number int, page_range string, "
              "chunk_index int, section_heading string, chunk_text string, normalized_text string, word_count int, "
              "token_count int, start_char_offset int, end_char_offset int",
    "vectors": "vector_id string, namespace string, values array<float>, embedding_model string",
    "jobs": "job_id string, document_id string, version_id string, job_type string, status string, "
            "progress_percent int, error_message string, summary_json string, created_at timestamp_ntz",
    "doc_metadata": "document_id string, version_id string, meta_key string, meta_value string, data_type string",
    "sessions": "session_token string, collection_id string, created_at timestamp_ntz",
    "question_answers": "qa_id string, session_token string, collection_id string, question string, answer string, "
                        "is_refusal boolean, latency_ms int, created_at timestamp_ntz",
    "citations": "qa_id string, document_id string, chunk_id string, page_number int, document_title string, "
                 "excerpt string, confidence_score double",
    "audit_events": "user_id string, action string, entity_type string, entity_id string, details string, "
                    "created_at timestamp_ntz",
    "feedback": "qa_id string, user_id string, rating int, feedback_text string, created_at timestamp_ntz",
}

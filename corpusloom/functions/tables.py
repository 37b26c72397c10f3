"""Typed schemas of the knowledge base's main tables."""

from __future__ import annotations

DOCUMENTS = (
    "id long, title string, file_name string, source_type string, legal_domain string, authority_level string, issuing_authority string, "
    "document_code string, document_type string, normative_level int, signed_date date, effective_date date, expiry_date date, legal_status string, "
    "source_reference string, storage_path string, metadata_review_status string, content_sha256 string, source_identity string, ingestion_quality_status string, "
    "retrieval_visibility string, ocr_quality_score decimal(5,2), ocr_quality_label string, is_active boolean"
)
CHUNKS = (
    "id long, document_id long, chunk_index int, section_title string, chunk_type string, citation_label string, hierarchy_path string, "
    "article_number string, clause_number string, point_number string, retrieval_text string, content string, metadata_json string, char_count int"
)
PROVISIONS = (
    "id long, document_id long, parent_provision_id long, provision_level string, article_number string, clause_number string, point_code string, "
    "heading string, content string, citation_label string, sort_key string, legal_status string, metadata_json string, is_active boolean"
)
RELATIONS = "source_document_id long, target_document_id long, relation_type string, relation_label string, legal_basis string, confidence_score decimal(5,4), metadata_json string, is_active boolean"
PROVISION_RELATIONS = (
    "source_document_id long, source_provision_id long, target_document_id long, target_provision_id long, relation_type string, relation_label string, "
    "source_excerpt string, target_excerpt string, confidence_score decimal(5,4), extraction_method string, is_active boolean"
)
USAGE = "request_type string, provider string, model string, document_id long, storage_path string, input_tokens long, output_tokens long, cached_tokens long, web_search_calls long, estimated_cost decimal(12,6), status string, created_at timestamp"

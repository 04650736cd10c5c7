"""The stages' tables, as DDL. Fields are only ever added, and then nullable; order in a list is a column of its own."""

from __future__ import annotations

QUESTION = "id string, text string, created_at timestamp, target_date timestamp, region string, pathogen string, event_type string, resolution_criteria string"
SUB_QUERY = "id string, question_id string, text string, axis string"
RAW_RESULT = "url string, title string, snippet string, rank int, published_date string, score double"
SEARCH_RESULT = "id string, question_id string, query_id string, engine string, url string, canonical_url string, domain string, title string, snippet string, rank int, retrieved_at timestamp, published_date timestamp, file_type string, language string, is_official_domain boolean, source_tier string, domain_score double, keyword_overlap_score double, freshness_score double, duplicate_cluster_id string, retrieval_reason string, contains_aggregator_forecast boolean, search_stage_score double"
DECISION = "result_id string, keep boolean, stage string, relevance_score double, credibility_score double, priority_score double, reason_codes array<string>, notes string"
FILTERED_DOCUMENT = "result_id string, question_id string, url string, canonical_url string, domain string, title string, snippet string, published_date timestamp, file_type string, relevance_score double, credibility_score double, final_score double, source_tier string, is_official_domain boolean, selection_reasons array<string>, extraction_priority int, extraction_mode string, expected_value string"
FETCH_RESULT = "url string, final_url string, status_code int, content_type string, content_bytes binary, fetched_at timestamp, error string"
SECTION = "section_path string, page_number int, text string, chunk_type string, table_rows array<array<string>>"
REPLY = "key string, raw_text string, input_tokens long, output_tokens long, model string"
PARSED = "raw_text string, sections array<struct<section_path:string,page_number:int,text:string,chunk_type:string,table_rows:array<array<string>>>>, title string, language string, page_count int, published_date string, is_partial boolean, partial_reason string, error string"
CHUNK = "chunk_id string, chunk_index int, text string, chunk_type string, heading string, page_number int, table_data array<array<string>>, token_count int"
FACTS = "facts array<struct<event_type:string,confidence:string,location:string,pathogen:string,metric_name:string,metric_value:string,metric_unit:string,event_date:string,summary:string,quote:string>>"
RECORD = "id string, question_id string, event_type string, confidence double, location string, iso_country_code string, pathogen string, metric_name string, metric_value double, metric_unit string, event_date timestamp, summary string, model string, extracted_at timestamp, notes string, sources array<struct<document_id:string,chunk_id:string,source_url:string,quote:string>>"
CACHE = "cache_key string, results_json string, created_at timestamp"

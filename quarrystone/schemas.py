"""Schemas of the records that travel as JSON, in the notation of SQL."""

from __future__ import annotations

FILING = (
    "ticker string, cik bigint, company string, form string, filing_date string, accession_no string, url string, path string, period_of_report string"
)
TABLE = "struct<table_index:int, caption:string, headers:array<string>, rows:array<array<string>>, n_rows:int, n_cols:int, statement_title:string>"
SECTION = (
    "struct<section_id:string, part:string, item:string, title:string, text:string, n_chars:int, n_tables:int, n_data_tables:int, is_key_section:boolean, is_stub:boolean, "
    f"resolved_from:string, confidence:double, detection_method:string, validated:boolean, warnings:array<string>, tables:array<{TABLE}>>"
)
PARSED = (
    f"ticker string, cik bigint, company string, form string, filing_date string, accession_no string, url string, source_path string, period_of_report string, sections array<{SECTION}>"
)
CHUNK = (
    "struct<chunk_id:string, section_id:string, part:string, item:string, title:string, heading:string, text:string, n_chars:int, chunk_index:int, is_key_section:boolean, "
    "incorporated_into:array<string>, content_type:string, table_index:int, table_caption:string>"
)
CHUNKED = (
    "ticker string, cik bigint, company string, form string, filing_date string, accession_no string, url string, source_path string, period_of_report string, "
    f"chunk_budget int, chunk_overlap int, key_items_only boolean, chunks array<{CHUNK}>"
)
QUESTION = (
    "question_id string, question string, expected_answer string, supporting_chunk_ids array<string>, hard_negative_chunk_ids array<string>, ticker string, fiscal_year int, question_type string, difficulty string, source string"
)
RUN_ROW = (
    "question_id string, retriever string, ids array<string>, scores array<double>, latency_ms double, config map<string,string>"
)
MANIFEST = (
    "index_type string, path string, corpus_fingerprint string, n_passages bigint, n_filings bigint, built_at string, model string, dimensions int, chunk_budget int, chunk_overlap int, passage_prefix string, max_tokens int"
)

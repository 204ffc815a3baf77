"""Row shapes that the stages exchange."""

from __future__ import annotations

from pyspark.sql.types import StructType

PAGES = "doc_id STRING, page INT, text STRING, tables ARRAY<STRING>"
SENTENCES = (
    "doc_id STRING, sentence_id STRING, global_index INT, zone_sentence_index INT, zone_id STRING, "
    "zone_type STRING, page_start INT, page_end INT, zone_start_offset INT, zone_end_offset INT, "
    "sentence_start_offset INT, sentence_end_offset INT, text STRING, norm_text STRING, "
    "dates ARRAY<STRING>, weak_dates ARRAY<STRING>, has_date BOOLEAN"
)
WINDOWS = (
    "doc_id STRING, window_id STRING, kind STRING, zone_id STRING, zone_type STRING, page_start INT, "
    "page_end INT, sentence_start_global_index INT, sentence_end_global_index INT, "
    "sentence_start_zone_index INT, sentence_end_zone_index INT, sentence_ids ARRAY<STRING>, "
    "date_sentence_ids ARRAY<STRING>, dates ARRAY<STRING>, weak_dates ARRAY<STRING>, "
    "has_strong_date BOOLEAN, has_weak_date BOOLEAN, text STRING"
)
ANNOTATION_ITEM = (
    "window_id STRING, zone_id STRING, zone_type STRING, page_start INT, page_end INT, "
    "sentence_ids ARRAY<STRING>, date_sentence_ids ARRAY<STRING>, dates ARRAY<STRING>, "
    "annotation_text STRING, error STRING"
)
FRAGMENT = (
    "STRUCT<source: STRING, text: STRING, sentence_ids: ARRAY<STRING>, zone_type: STRING, zone_id: STRING, "
    "page_start: INT, page_end: INT, matched_keyword: STRING, search_stage: STRING>"
)
CONTEXT_ITEM = (
    f"path STRING, reason STRING, source_audit_block STRING, fragments ARRAY<{FRAGMENT}>, "
    "context_chars INT, skipped BOOLEAN"
)
MERGED_FRAGMENT = (
    "text STRING, source_window_ids ARRAY<STRING>, source_zone_ids ARRAY<STRING>, source_zone_types ARRAY<STRING>, "
    "source_dates ARRAY<STRING>, source_sentence_ids ARRAY<STRING>, source_date_sentence_ids ARRAY<STRING>"
)
REFINEMENT_ITEM = "extraction_type STRING, target_paths ARRAY<STRING>, answer_text STRING, error STRING"
EXTRACTION_RESPONSES = (
    "doc_id STRING, extractor_seq BIGINT, extractor STRING, answer_text STRING, error STRING, skipped BOOLEAN"
)


def parse(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)

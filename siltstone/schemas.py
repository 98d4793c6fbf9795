"""Explicit schemas of the tables, and the migration of older snapshots to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DDL = {
    "sources": "source_id string, display_name string, origin_url string, allowed_hosts array<string>, allowed_path_prefixes array<string>, seed_urls array<string>, discovery string, rate_limit_rps double, keep_query_strings boolean",
    "ingestion_runs": "id string, source_id string, status string, started_at timestamp, finished_at timestamp, error_type string, error_message string",
    "catalog_urls": "source_id string, canonical_url string, document_id string, discovered_from string, fetch_status string, http_status int, etag string, last_modified string, content_type string, size_bytes int, content_sha256 string, extracted_sha256 string, chunker_version string, indexed_sha256 string, indexed_chunker_version string, error_type string, error_message string, attempt_count int, fetched_at timestamp, last_success_at timestamp, last_seen_run_id string, last_touched_run_id string, consecutive_missing_success_runs int, is_in_corpus int, duplicate_of string, created_at timestamp, updated_at timestamp",
    "fetch_results": "fetch_id bigint, source_id string, run_id string, ok boolean, status string, reason string, requested_url string, canonical_url string, final_url string, http_status int, content_type string, body binary, etag string, last_modified string, size_bytes int, attempts int, error_type string, error_message string, fetched_at timestamp",
    "extract_results": "extract_id bigint, ok boolean, reason string, document_id string, canonical_url string, source_id string, title string, extracted_text string, extracted_sha256 string, heading_outline array<string>, run_id string, extracted_at timestamp",
    "document_chunks": "chunk_id string, document_id string, source_id string, canonical_url string, title string, headings array<string>, breadcrumb string, text string, primary_text string, content_hash string, extracted_sha256 string, chunk_index int, chunker_version string, token_count int",
    "vector_points": "point_id string, vector array<float>, source_id string, document_id string, chunk_id string, chunk_index int, canonical_url string, title string, headings array<string>, breadcrumb string, text string, content_hash string, chunker_version string, embedding_model string, ingestion_run_id string, is_active boolean, created_at timestamp",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, title string, added_at timestamp",
}
#: Values of the status columns.
RUN_STATUSES = ("started", "succeeded", "failed")
URL_STATUSES = ("pending", "fetched", "skipped", "failed", "rejected", "robots_disallowed", "gone")


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def migrate(df: DataFrame, name: str) -> DataFrame:
    """df in the table's schema: missing columns are null, others cast; running it again changes nothing."""
    have = {c.lower() for c in df.columns}
    return df.select(*((F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))


def mismatches(df: DataFrame, name: str) -> list[str]:
    """Columns of the schema that df lacks or has in another type."""
    have = {f.name: f.dataType.simpleString().replace("timestamp_ntz", "timestamp") for f in df.schema}
    return [f.name for f in schema(name) if have.get(f.name) != f.dataType.simpleString()]

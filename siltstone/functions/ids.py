"""Deterministic identifiers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Part of every chunk's identity (a fixed value).
CHUNKER_VERSION = "heading-v1"


def sha256_text(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in lower-case hex; null for null."""
    return F.sha2(text, 256)


def document_id(source_id: Column, canonical_url: Column) -> Column:
    """Identity of a page: its source and its canonical address, a newline between them."""
    return F.sha2(F.concat(source_id, F.lit("\n"), canonical_url), 256)


def chunk_id(source_id: Column, canonical_url: Column, index: Column, version: str = CHUNKER_VERSION) -> Column:
    """Identity of a chunk: source, address, version and position, without separators."""
    return F.sha2(F.concat(source_id, canonical_url, F.lit(version), index.cast("string")), 256)


def point_id(chunk: Column) -> Column:
    """The UUID (version 8, RFC variant) made of the first 16 bytes of a 64-digit hex id; null for anything else."""
    h = F.lower(chunk)
    version = F.lpad(F.lower(F.hex((F.conv(F.substring(h, 13, 2), 16, 10).cast("int").bitwiseAND(0x0F)).bitwiseOR(0x80))), 2, "0")
    variant = F.lpad(F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80))), 2, "0")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(version, F.substring(h, 15, 2)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
    return F.when(h.rlike("^[0-9a-f]{64}$"), uuid)


def fingerprint16(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256, for logs that must not hold the text."""
    return F.substring(F.sha2(text, 256), 1, 16)

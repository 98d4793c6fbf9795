"""The vector index as a table of points: upserts, deactivation and what is stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import ids
from siltstone.operators.catalog import latest

DIM = 384


def current_points(points: DataFrame) -> DataFrame:
    """Last write wins: of each point_id the row with the greatest created_at."""
    return latest(points.where("point_id is not null"), ["point_id"], "created_at")


def check_dimension(points: DataFrame, dim: int = DIM) -> DataFrame:
    """points with dimension_ok: the vector has `dim` numbers."""
    return points.withColumn("dimension_ok", F.coalesce(F.size("vector") == dim, F.lit(False)))


def require_dimension(points: DataFrame, dim: int = DIM) -> DataFrame:
    """points; the job fails at a vector of another length, before anything is written."""
    wrong = F.col("vector").isNotNull() & (F.size("vector") != dim)
    return points.withColumn("vector", F.when(wrong, F.raise_error(F.concat(F.lit(f"a vector must have {dim} numbers, not "), F.size("vector").cast("string")))).otherwise(F.col("vector")))


def set_active(points: DataFrame, chosen: DataFrame, flag: bool) -> DataFrame:
    """points with is_active set to `flag` for chosen(point_id)."""
    hit = chosen.select("point_id").distinct().withColumn("_chosen", F.lit(True))
    return points.join(hit, "point_id", "left").withColumn("is_active", F.when(F.col("_chosen"), F.lit(flag)).otherwise(F.col("is_active"))).drop("_chosen")


def stale_points(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active points whose chunk is not among chunks(source_id, canonical_url, chunk_index): an anti-join on the identity that the chunk would have."""
    wanted = chunks.select(ids.point_id(ids.chunk_id(F.col("source_id"), F.col("canonical_url"), F.col("chunk_index"))).alias("point_id")).distinct()
    return points.where("is_active").join(wanted, "point_id", "left_anti")


def deactivate(points: DataFrame, documents: DataFrame) -> DataFrame:
    """points with is_active false for all points of documents(document_id); was_active keeps the flag before."""
    gone = documents.select("document_id").distinct().withColumn("_gone", F.lit(True))
    return points.join(gone, "document_id", "left").withColumn("was_active", F.col("is_active")).withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")


def points_from_chunks(chunks: DataFrame, embed, run_id: str, model: str, created_at) -> DataFrame:  # noqa: ANN001
    """The payload of a point per chunk; embed is a column function from text to vector."""
    return chunks.select(
        ids.point_id(F.col("chunk_id")).alias("point_id"), "source_id", "document_id", "chunk_id", "canonical_url", "title", "breadcrumb", "text", "content_hash", "chunker_version",
        F.lit(model).alias("embedding_model"), F.lit(run_id).alias("ingestion_run_id"), embed(F.col("text")).alias("vector"), "headings", "chunk_index", F.lit(True).alias("is_active"), F.lit(created_at).alias("created_at"),
    )

"""The vector store as a table: versions of one snapshot, replaced whole by every change, so a search sees the points before or after a change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.operators import index, retrieval, snapshots
from siltstone.session import stage


class VectorStore:
    """Points by point_id in a folder; the last upsert of an id holds. Vectors have `dim` numbers, anything else fails before it is written."""

    def __init__(self, spark: SparkSession, folder: str, dim: int = index.DIM) -> None:
        self.spark, self.folder, self.dim = spark, folder, dim

    def points(self) -> DataFrame:
        """All points, inactive ones too; none if nothing was written yet."""
        if snapshots.exists(self.spark, self.folder, "points"):
            return snapshots.current(self.spark, self.folder, "points")
        return self.spark.createDataFrame([], schemas.schema("vector_points"))

    def _write(self, df: DataFrame) -> None:
        snapshots.commit(index.require_dimension(df, self.dim), self.folder, "points")

    def upsert(self, new: DataFrame) -> None:
        """Write points; of several rows of an id the one with the greatest created_at holds, and it replaces what was there."""
        rows = index.current_points(schemas.migrate(new, "vector_points"))
        self._write(self.points().join(rows.select("point_id"), "point_id", "left_anti").unionByName(rows))

    def set_active(self, chosen: DataFrame, flag: bool) -> None:
        """Switch chosen(point_id) on or off."""
        self._write(index.set_active(self.points(), chosen, flag))

    def deactivate(self, documents: DataFrame) -> None:
        """Switch off all points of documents(document_id)."""
        self._write(index.deactivate(self.points(), documents).drop("was_active"))

    def of_documents(self, documents: DataFrame) -> DataFrame:
        """The points of documents(document_id)."""
        return self.points().join(documents.select("document_id").distinct(), "document_id", "left_semi")

    def search(self, queries: DataFrame, k: int, threshold: float = -1.0, by_source: bool = False) -> DataFrame:
        """(query_id, rank, score, and the payload with defaults) of the k active points most like each of queries(vec_id, vector, source_id); with by_source only those of
        the query's source. The threshold comes after the k; ties fall by source, document, chunk and point. Each chunk comes once."""
        # numbered once and staged: a second sort might draw other borders between its partitions
        live = self.points().where(F.col("is_active") & F.col("vector").isNotNull()).sort("source_id", "document_id", "chunk_id", "point_id").withColumn("no", F.monotonically_increasing_id())
        live = stage(live, "live")
        asked = queries.select(F.col("vec_id").alias("no"), "vector", *(["source_id"] if by_source else []))
        hits = retrieval.search(asked, live, k, "no", "vector", group="source_id" if by_source else None).where(F.col("score") >= threshold)
        whole = hits.withColumnRenamed("point_id", "no").join(live.drop("vector"), "no").withColumn("chunk", F.coalesce("chunk_id", "point_id"))
        return retrieval.with_defaults(retrieval.first_of(whole, ["query_id", "chunk"], [F.desc("score"), F.col("no")]).drop("chunk", "no"))

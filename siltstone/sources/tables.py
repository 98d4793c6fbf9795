"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under sf_dir. Columns and filters are pushed to the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

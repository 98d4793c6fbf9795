"""Versioned tables in a folder: a version is whole once its writer's _SUCCESS mark lies in it, and the newest whole one holds.

Nothing is renamed or deleted in order to publish, so readers see the version before or the one after, on file systems and object stores alike.
One writer at a time is assumed; of two that write the same number the greater name holds. The version before is kept for those who still read it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

KEPT = 2


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) of the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    fs, at = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, folder: str, name: str) -> list[str]:
    """The paths of the whole versions, oldest first."""
    out = []
    for child in children(spark, f"{folder}/{name}"):
        fs, mark = file_system(spark, f"{folder}/{name}/{child}/_SUCCESS")
        if fs.exists(mark):
            out.append(f"{folder}/{name}/{child}")
    return out


def commit(df: DataFrame, folder: str, name: str) -> str:
    """Write a version after the newest whole one; older ones than the last `KEPT` and what writers left half done are deleted."""
    spark = df.sparkSession
    old = versions(spark, folder, name)
    number = int(old[-1].rpartition("/")[2].split("-")[0]) + 1 if old else 0
    path = f"{folder}/{name}/{number:012d}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = {p.rpartition("/")[2] for p in [*old, path][-KEPT:]}
    for child in children(spark, f"{folder}/{name}"):
        if child not in kept:
            fs, at = file_system(spark, f"{folder}/{name}/{child}")
            fs.delete(at, True)
    return path


def exists(spark: SparkSession, folder: str, name: str) -> bool:
    return bool(versions(spark, folder, name))


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The newest whole version."""
    found = versions(spark, folder, name)
    if not found:
        raise FileNotFoundError(f"no version of {name} in {folder}")
    return spark.read.parquet(found[-1])


class Transaction:
    """Several tables of a folder that change together: what was put is seen by others once the outermost `with` ends, all of it or nothing.

    The tables are written at once, beside those that hold; a version of the manifest, which names the table of each name, publishes them. After an error the manifest stays
    as it was and what was written is deleted. A transaction entered again inside itself ends with the outer one, and fails it if it fails.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.depth, self.written, self.failed = spark, folder, 0, {}, False

    def __enter__(self) -> Transaction:
        self.depth += 1
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        self.depth -= 1
        self.failed |= kind is not None
        if self.depth:
            return
        (written, failed), self.written, self.failed = (self.written, self.failed), {}, False
        if failed:
            for path in written.values():
                fs, at = file_system(self.spark, path)
                fs.delete(at, True)
            if kind is None:
                raise RuntimeError("a part of the transaction failed")
        elif written:
            rows = list({**self.paths(), **written}.items())
            commit(self.spark.createDataFrame(rows, "name string, path string").coalesce(1), self.folder, "manifest")

    def paths(self) -> dict[str, str]:
        """The published tables: one path per name."""
        return dict(tuple(r) for r in current(self.spark, self.folder, "manifest").collect()) if exists(self.spark, self.folder, "manifest") else {}

    def put(self, name: str, df: DataFrame) -> None:
        if not self.depth:
            raise RuntimeError("outside a transaction")
        path = f"{self.folder}/tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.written[name] = path

    def get(self, name: str) -> DataFrame:
        """The table as this transaction has put it, else as it was published."""
        path = self.written.get(name) or self.paths().get(name)
        if path is None:
            raise FileNotFoundError(f"no {name} in {self.folder}")
        return self.spark.read.parquet(path)

"""Session helpers: parallelism, staging of intermediate tables, bounded Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch between the JVM and Python. Texts may be long, so a batch is kept small.
ARROW_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: executors need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siltstone-")) / "siltstone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset a local session gets a temporary one; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "siltstone-shared")
    return at.rstrip("/")


_staged: dict[str, list[str]] = {}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, so that several consumers share one computation.

    The written table survives the loss of executors. It is deleted by release(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at.getParent())
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that were staged so far, whose number comes back: for long sessions, between queries whose results have been written."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as the session's setting `siltstone.tasks` asks for, before a CPU-bound Python stage. Unset, which is right for tables of many files, the
    scan's own splits are kept and nothing is shuffled; a table in one small file is read by one task unless it is set."""
    tasks = df.sparkSession.conf.get("siltstone.tasks", None)
    return df.repartition(int(tasks)) if tasks else df


def deal(df: DataFrame, *key: str) -> DataFrame:
    """df by a hash of its key in as many partitions as `siltstone.tasks`, or else `spark.sql.shuffle.partitions`, asks for: for a table of small rows of which each makes much
    work, as a scan splits by bytes and would give all of it to one task. Deal before the rows are widened, so that only the small ones are shuffled."""
    conf = df.sparkSession.conf
    return df.repartition(int(conf.get("siltstone.tasks", None) or conf.get("spark.sql.shuffle.partitions")), *key)

"""Structured Streaming over event files: deduplication, sessions, windows and upserts, each with the watermark as a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import snapshots
from siltstone.operators.catalog import latest


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder, or one file, as a stream; ts as a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        rows = spark.readStream.schema(schema).parquet(path)
    else:  # streams read folders
        folder, _, name = path.rpartition("/")
        rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _marked(events: DataFrame, delay: str | None) -> DataFrame:
    """events with a watermark; with delay None, events have one already."""
    return events if delay is None else events.withWatermark("ts", delay)


def deduplicated(events: DataFrame, key: str = "event_id", delay: str | None = "10 minutes") -> DataFrame:
    """Each key once; its state is dropped when the watermark has passed."""
    return _marked(events, delay).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, user: str = "user_id", gap: str = "30 minutes", delay: str | None = "10 minutes") -> DataFrame:
    """(user, start, end, n, total) of sessions closed by a gap."""
    grouped = _marked(events, delay).groupBy(F.session_window("ts", gap).alias("w"), user)
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def windows(events: DataFrame, width: str = "1 hour", delay: str | None = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window."""
    grouped = _marked(events, delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


#: Micro-batches whose changes lie beside the state before they are folded into it.
FOLD_AFTER = 16


def merged_state(spark: SparkSession, folder: str, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: the newest whole state and the changes beside it. Changes that the state holds already make no difference."""
    parts = [snapshots.current(spark, folder, "state")] if snapshots.exists(spark, folder, "state") else []
    parts += [spark.read.parquet(f"{folder}/changes/{b}") for b in _batches(spark, folder)]
    if not parts:
        raise FileNotFoundError(f"no state in {folder}")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return latest(rows, keys, order)


def _batches(spark: SparkSession, folder: str) -> list[str]:
    """The whole changes beside the state, by their batch."""
    fs = lambda b: snapshots.file_system(spark, f"{folder}/changes/{b}/_SUCCESS")
    return [b for b in snapshots.children(spark, f"{folder}/changes") if (lambda f: f[0].exists(f[1]))(fs(b))]


def upserts(events: DataFrame, keys: list[str], order: str, folder: str, fold_after: int = FOLD_AFTER) -> DataFrame:
    """Keep the last row of each key over all micro-batches, in `folder`, and give the state after what is there was read.

    A batch writes the last rows of its own keys, in proportion to itself, under its number: a batch that is repeated replaces what it wrote. Every `fold_after`
    batches the changes are folded into a new version of the state, and deleted after it is whole. The checkpoint lies in the folder too, so a
    stream that was stopped at any step goes on where it was.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{folder}/changes/{number:012d}")
        done = _batches(spark, folder)
        if len(done) >= fold_after:
            snapshots.commit(merged_state(spark, folder, keys, order), folder, "state")
            for b in done:
                fs, at = snapshots.file_system(spark, f"{folder}/changes/{b}")
                fs.delete(at, True)

    events.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return merged_state(events.sparkSession, folder, keys, order)


def run_to_table(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what is there and give its result, which lies in `folder` with the checkpoint: in append mode all rows written so far, in
    complete mode the newest whole version of the aggregate. A stream that was stopped goes on where it was."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{folder}/out").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    writer.foreachBatch(lambda batch, _: snapshots.commit(batch, folder, "out") and None).start().awaitTermination()
    return snapshots.current(spark, folder, "out")

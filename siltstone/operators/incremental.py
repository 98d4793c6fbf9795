"""Problem 3: process only what is new or changed.

Method: per-partition fingerprints. The rows of a table are dealt to partitions by their key; a partition's fingerprint is its number of rows and two
sums of row hashes, which do not depend on the order of rows. A run compares the fingerprints with those of the last
successful run, recomputes only the partitions that differ and replaces each atomically by dynamic partition overwrite.

A partition has a fingerprint only while its stored result belongs to it: before a run overwrites partitions it records the fingerprints without
theirs, and after it has written them it records all. Whatever step fails, and whatever the table holds when the next run comes, partitions that were begun, that
lie in the folder without a fingerprint or that have lost all rows are recomputed, so no record is skipped, repeated or left over.

Records change together: a crawl touches the pages of one source. The columns `cluster` (leading keys) choose a group of partitions, the whole key one of its
`spread` partitions, so a run over one source leaves the other sources' partitions alone, and one source with most rows still has many partitions. A partition
has about `ROWS` rows; their number is kept with the state, and a table that has outgrown it fourfold is dealt anew, which recomputes all.

Defined results: an empty table gives no page; of several rows of a page the one with the greatest updated_at holds (a null one is the
oldest, ties are broken by the row's hash); outer blanks and case of hashes and versions make no difference, an empty value is a missing one;
partitions whose rows have vanished are emptied. Rows without a source_id or canonical_url are no pages.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import snapshots
from siltstone.session import stage

#: Rows of a partition on average, the least and the greatest number of partitions, and how many of them the records of one cluster are spread over.
ROWS, FEWEST, MOST, SPREAD = 100_000, 32, 8192, 8
PRINTS = "part int, n bigint, h1 string, h2 string, of int"


def partitions_for(rows: int) -> int:
    """A power of two, so that partitions hold about `ROWS` rows."""
    return min(MOST, max(FEWEST, 1 << math.ceil(math.log2(max(1, rows / ROWS)))))


def bucket(keys: list[str], partitions: int, cluster: list[str] | None = None, spread: int = SPREAD) -> Column:
    """The partition of a key: by the hash of all keys, or a group of `spread` partitions by the hash of `cluster` and one of them by that of all."""
    if not cluster or partitions < 2 * spread:
        return F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int")
    group = F.pmod(F.xxhash64(F.lit(1), *cluster), F.lit(partitions // spread))
    return (group * spread + F.pmod(F.xxhash64(*keys), F.lit(spread))).cast("int")


def fingerprints(df: DataFrame, part: Column, columns: list[str], partitions: int) -> DataFrame:
    """(part, n, h1, h2, of): number of rows and additive hashes of each partition. One partial aggregate per task, one row per partition shuffled."""
    rows = df.select(part.alias("part"), F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7), *columns).alias("b"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("string")
    return rows.groupBy("part").agg(F.count("*").alias("n"), wide("a").alias("h1"), wide("b").alias("h2")).withColumn("of", F.lit(partitions))


@dataclass
class Change:
    """What a run has to do: the fingerprints now, the partitions that differ from the stored ones, and those that stay."""

    part: Column
    partitions: int
    now: DataFrame
    parts: list[int]
    same: DataFrame


def changes(df: DataFrame, keys: list[str], columns: list[str], state: str, partitions: int | None = None, cluster: list[str] | None = None) -> Change:
    """Compare the table with the state. The partitions come to the driver: their number is bounded by `MOST`, or given."""
    spark = df.sparkSession
    then = snapshots.current(spark, state, "fingerprints") if snapshots.exists(spark, state, "fingerprints") else spark.createDataFrame([], PRINTS)
    kept = then.agg(F.max("of")).first()[0]
    if partitions is None:
        wanted = partitions_for(df.count())
        partitions = kept if kept and wanted <= 4 * kept else wanted
    part = bucket(keys, partitions, cluster)
    now = stage(fingerprints(df, part, columns, partitions), "fingerprints")
    row = ["part", "n", "h1", "h2", "of"]
    same = stage(then.join(now, row, "left_semi").select(*row), "same")
    stays = {r[0] for r in same.select("part").collect()}
    stored = {int(c.removeprefix("part=")) for c in snapshots.children(spark, f"{state}/result") if c.startswith("part=")}
    parts = sorted(({r[0] for r in now.select("part").collect()} | stored) - stays)
    return Change(part, partitions, now, parts, same)


def replace(df: DataFrame, change: Change, compute: Callable[[DataFrame], DataFrame], state: str) -> None:
    """Take back the fingerprints of the changed partitions, then overwrite these partitions of the result.

    The stored result holds one marker row per partition, so that a partition that becomes empty is replaced too.
    """
    spark = df.sparkSession
    snapshots.commit(change.same, state, "fingerprints")
    rows = df.where(change.part.isin(change.parts)) if len(change.parts) < change.partitions else df
    found = compute(rows).withColumn("part", change.part).withColumn("marker", F.lit(False))
    markers = spark.createDataFrame([(p,) for p in change.parts], "part int").withColumn("marker", F.lit(True))
    whole = found.unionByName(markers, allowMissingColumns=True).hint("rebalance", "part")  # large partitions in several files
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{state}/result")


def record(change: Change, state: str) -> None:
    """The run was successful: its fingerprints hold."""
    snapshots.commit(change.now, state, "fingerprints")


def stored(spark: SparkSession, state: str) -> DataFrame:
    """The stored result."""
    return spark.read.parquet(f"{state}/result").where("not marker").drop("part", "marker")


def refresh(df: DataFrame, keys: list[str], columns: list[str], compute: Callable[[DataFrame], DataFrame], state: str, partitions: int | None = None, cluster: list[str] | None = None) -> DataFrame:
    """compute(df) by partition of its keys, kept in the folder `state` and recomputed for the changed partitions only.

    compute must give, for the rows of some keys, the result of those keys, with the keys and without columns `part` and `marker`. Without rows and
    without a state its empty result comes back.
    """
    change = changes(df, keys, columns, state, partitions, cluster)
    if change.parts:
        replace(df, change, compute, state)
        record(change, state)
    elif not snapshots.children(df.sparkSession, f"{state}/result"):
        return compute(df)
    return stored(df.sparkSession, state)


PAGE_KEY = ["source_id", "canonical_url"]
PAGE_COLUMNS = ["source_id", "canonical_url", "updated_at", "is_in_corpus", "duplicate_of", "extracted_sha256", "chunker_version", "indexed_sha256", "indexed_chunker_version"]


def present(name: str) -> Column:
    """A hash or version as it is compared: trimmed, in lower case, null where empty."""
    value = F.lower(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""))
    return F.when(value != "", value)


def newest_pages(catalog: DataFrame) -> DataFrame:
    """The row that holds of each page: the greatest updated_at. Only the columns that matter are shuffled, after a partial maximum."""
    rest = [c for c in PAGE_COLUMNS if c not in PAGE_KEY]
    row = F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), F.xxhash64(*rest).alias("tie"), *rest)
    return catalog.where("source_id is not null and canonical_url is not null").groupBy(*PAGE_KEY).agg(F.max(row).alias("row")).select(*PAGE_KEY, "row.*")


def pending_pages(catalog: DataFrame) -> DataFrame:
    """(source_id, canonical_url) of the pages to be processed: in the corpus, no duplicate, extracted, and not indexed at this extraction and version."""
    same = (present("indexed_sha256") == present("extracted_sha256")) & (present("indexed_chunker_version") == present("chunker_version"))
    wanted = (F.col("is_in_corpus") == 1) & present("duplicate_of").isNull() & present("extracted_sha256").isNotNull() & ~F.coalesce(same, F.lit(False))
    return newest_pages(catalog).where(wanted).select(*PAGE_KEY)


def pending_since(catalog: DataFrame, state: str, partitions: int | None = None) -> DataFrame:
    """pending_pages(catalog), kept in `state` by partition."""
    return refresh(catalog, PAGE_KEY, PAGE_COLUMNS, pending_pages, state, partitions, PAGE_KEY[:1])

"""The page catalog and the run ledger as snapshots: every mutation is a join of the old snapshot with a batch of changes.

A snapshot is never overwritten while it is read: snapshots.commit() writes a new version beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import ids
from siltstone.operators.incremental import present

KEY = ["source_id", "canonical_url"]
DELETE_AFTER = 2


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest `order` (a null one is the smallest; ties by the row's hash): one aggregate with a partial maximum in each task before the one shuffle.

    Rows hold strings, so the aggregate sorts within its tasks; a hash aggregate over times and hashes alone would need a second shuffle to fetch the rows.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(F.col(order).isNotNull().alias("_known"), F.col(order).alias("_at"), F.xxhash64(*rest).alias("_tie"), *rest)
    return df.groupBy(*keys).agg(F.max(row).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def written(catalog: DataFrame, batch: DataFrame, changes: dict[str, Column], how: str = "left") -> DataFrame:
    """catalog with the columns `changes` where batch has a row for the page: the old row's columns are `old.x`, the batch's `new.x`. Columns that the catalog lacks are
    added. With how "full_outer" pages that only the batch knows are added too; else they are ignored."""
    both = catalog.alias("old").join(batch.withColumn("_hit", F.lit(True)).alias("new"), KEY, how)
    keep = [c for c in catalog.columns if c not in KEY]
    value = {c: F.col(f"old.{c}") if c in keep else F.lit(None) for c in [*keep, *(c for c in changes if c not in keep)]}
    return both.select(*KEY, *(F.when(F.col("new._hit"), changes[c]).otherwise(v).alias(c) if c in changes else v.alias(c) for c, v in value.items()))


def register(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """Upsert of found(source_id, canonical_url, run_id, discovered_from, at): new pages pend; known ones are seen again, in the corpus, keep their first discoverer and fetch state."""
    batch = found.groupBy(*KEY).agg(F.max("run_id").alias("run_id"), F.min_by("discovered_from", "at").alias("discovered_from"), F.max("at").alias("at"))
    old = lambda c: F.col(f"old.{c}") if c in catalog.columns else F.lit(None)
    return written(catalog, batch, {
        "document_id": F.coalesce(old("document_id"), ids.document_id(F.col("source_id"), F.col("canonical_url"))),
        "discovered_from": F.coalesce(old("discovered_from"), F.col("new.discovered_from")),
        "fetch_status": F.coalesce(old("fetch_status"), F.lit("pending")),
        "attempt_count": F.coalesce(old("attempt_count"), F.lit(0)),
        "last_seen_run_id": F.col("new.run_id"),
        "last_touched_run_id": F.col("new.run_id"),
        "consecutive_missing_success_runs": F.lit(0),
        "is_in_corpus": F.lit(1),
        "created_at": F.coalesce(old("created_at"), F.col("new.at")),
        "updated_at": F.greatest(old("updated_at"), F.col("new.at")),
    }, "full_outer")


#: What a success overwrites, whatever its values are.
VALIDATORS = ("etag", "last_modified", "content_type", "size_bytes", "content_sha256")


def record_fetches(catalog: DataFrame, fetched: DataFrame) -> DataFrame:
    """Outcomes fetched(source_id, canonical_url, run_id, ok, status, http_status, etag, last_modified, content_type, size_bytes, content_sha256, error_type, error_message,
    at) folded into the catalog, as if they were written one after the other: attempts are added; a success overwrites the validators and clears the errors; a failure
    keeps them and the last success, has the status failed unless it names another, and keeps the HTTP status known before if it has none. `at` may be a struct whose first field is the
    time; outcomes without a time are the oldest."""
    timed = fetched.schema["at"].dataType.typeName() == "struct"
    time = F.col("at")[fetched.schema["at"].dataType.names[0]] if timed else F.col("at")
    rows = fetched.select(*KEY, "run_id", F.coalesce("ok", F.lit(False)).alias("ok"), "status", "http_status", *VALIDATORS, "error_type", "error_message", time.alias("time"), F.struct(time.isNotNull(), "at").alias("order"))
    last = F.max_by(F.struct("run_id", "ok", "status", "error_type", "error_message", "time"), "order")
    success = F.max_by(F.struct(*VALIDATORS, "time"), F.when(F.col("ok"), F.col("order")))
    status = F.max_by(F.struct("http_status"), F.when(F.col("ok") | F.col("http_status").isNotNull(), F.col("order")))  # a failure without one keeps the one before
    batch = rows.groupBy(*KEY).agg(F.count("*").cast("int").alias("n"), last.alias("last"), success.alias("success"), status.alias("seen"))
    ok, old = F.col("new.last.ok"), lambda c: F.col(f"old.{c}") if c in catalog.columns else F.lit(None)
    return written(catalog, batch, {
        "attempt_count": F.coalesce(old("attempt_count"), F.lit(0)) + F.col("new.n"),
        "fetch_status": F.when(ok, "fetched").otherwise(F.coalesce(F.col("new.last.status"), F.lit("failed"))),
        "http_status": F.when(F.col("new.seen").isNotNull(), F.col("new.seen.http_status")).otherwise(old("http_status")),
        **{c: F.when(F.col("new.success").isNotNull(), F.col(f"new.success.{c}")).otherwise(old(c)) for c in VALIDATORS},
        "error_type": F.when(~ok, F.col("new.last.error_type")),
        "error_message": F.when(~ok, F.col("new.last.error_message")),
        "last_success_at": F.coalesce(F.col("new.success.time"), old("last_success_at")),
        "fetched_at": F.coalesce(F.col("new.last.time"), old("fetched_at")),
        "last_touched_run_id": F.col("new.last.run_id"),
        "updated_at": F.greatest(old("updated_at"), F.col("new.last.time")),
    })


def record_extractions(catalog: DataFrame, extracted: DataFrame) -> DataFrame:
    """extracted(source_id, canonical_url, run_id, extracted_sha256, chunker_version, duplicate_of, at): the last extraction of a page overwrites hash, version and duplicate_of, which may be null."""
    return _recorded(catalog, extracted, {c: c for c in ("extracted_sha256", "chunker_version", "duplicate_of")})


def record_indexing(catalog: DataFrame, indexed: DataFrame) -> DataFrame:
    """indexed(source_id, canonical_url, run_id, extracted_sha256, chunker_version, at), pages whose points were written: the last one's hash and version are the indexed ones."""
    return _recorded(catalog, indexed, {"indexed_sha256": "extracted_sha256", "indexed_chunker_version": "chunker_version"})


def record_misses(catalog: DataFrame, missed: DataFrame) -> DataFrame:
    """missed(source_id, canonical_url, run_id, at), one row for each time that a page was looked for in vain: its misses are added."""
    batch = missed.groupBy(*KEY).agg(F.count("*").cast("int").alias("n"), F.max_by("run_id", F.struct(F.col("at").isNotNull(), "at")).alias("run_id"), F.max("at").alias("at"))
    old = lambda c: F.col(f"old.{c}") if c in catalog.columns else F.lit(None)
    return written(catalog, batch, {"consecutive_missing_success_runs": F.coalesce(old("consecutive_missing_success_runs"), F.lit(0)) + F.col("new.n"), "last_touched_run_id": F.col("new.run_id"), "updated_at": F.greatest(old("updated_at"), F.col("new.at"))})


def _recorded(catalog: DataFrame, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    row = F.struct(F.col("at").isNotNull().alias("known"), "at", "run_id", *columns.values())
    batch = rows.groupBy(*KEY).agg(F.max(row).alias("row"))
    old = F.col("old.updated_at") if "updated_at" in catalog.columns else F.lit(None)
    return written(catalog, batch, {**{c: F.col(f"new.row.{x}") for c, x in columns.items()}, "last_touched_run_id": F.col("new.row.run_id"), "updated_at": F.greatest(old, F.col("new.row.at"))})


def needs_processing(catalog: DataFrame) -> DataFrame:
    """catalog with needs_processing (no extraction at a known version) and needs_indexing (not indexed at the extraction and version)."""
    extracted, version = present("extracted_sha256"), present("chunker_version")
    current = present("indexed_sha256").eqNullSafe(extracted) & present("indexed_chunker_version").eqNullSafe(version) & extracted.isNotNull()
    return catalog.withColumn("needs_processing", extracted.isNull() | version.isNull()).withColumn("needs_indexing", ~current)


def count_missing(catalog: DataFrame, run_of_source: DataFrame) -> DataFrame:
    """One more miss for each page in the corpus that its source's run(source_id, run_id) did not see; pages of sources without a run are untouched."""
    both = catalog.join(run_of_source, "source_id", "left")
    missed = F.col("run_id").isNotNull() & (F.col("is_in_corpus") == 1) & ~F.col("last_seen_run_id").eqNullSafe(F.col("run_id"))
    return both.withColumn("missed", F.coalesce(missed, F.lit(False))).withColumn("misses", F.coalesce("consecutive_missing_success_runs", F.lit(0)) + F.col("missed").cast("int")).drop("run_id")


def soft_delete(missed: DataFrame, after: int = DELETE_AFTER) -> DataFrame:
    """Pages out of the corpus once they were missed `after` times in a row: newly_deleted and deleted tell them apart."""
    over = F.col("misses") >= after
    return missed.withColumn("newly_deleted", over & (F.col("is_in_corpus") == 1)).withColumn("deleted", over | (F.coalesce(F.col("is_in_corpus"), F.lit(0)) == 0))


def open_runs(runs: DataFrame, starts: DataFrame) -> DataFrame:
    """runs with starts(id, source_id, started_at) as started ones; an id that is known stays as it is."""
    fresh = starts.select("id", "source_id", F.lit("started").alias("status"), "started_at").join(runs.select("id"), "id", "left_anti")
    return runs.unionByName(fresh, allowMissingColumns=True)


def finish_runs(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """runs with ends(id, succeeded, finished_at, error_message) applied; only started runs can end, others get the flag rejected."""
    both = runs.join(ends.withColumnRenamed("finished_at", "end_at").withColumnRenamed("error_message", "end_message"), "id", "left")
    asked, can = F.col("succeeded").isNotNull(), F.col("status") == "started"
    return both.select(
        "id", "source_id", "started_at",
        F.when(asked & can, F.when(F.col("succeeded"), "succeeded").otherwise("failed")).otherwise(F.col("status")).alias("status"),
        F.when(asked & can, F.col("end_at")).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(asked & can, F.col("end_message")).otherwise(F.col("error_message")).alias("error_message"),
        (asked & ~can).alias("rejected"),
    )


def exact_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with duplicate_of: the first row's id in its group of equal keys, null for the first. First by `order`, whose last column is the id."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    ident = order[-1]
    both = df.alias("d").join(first.alias("f"), [F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys])
    return both.select("d.*", F.when(F.col(f"f._first.{ident}") != F.col(f"d.{ident}"), F.col(f"f._first.{ident}")).alias("duplicate_of"))


def run_report(runs: DataFrame, fetches: DataFrame, limit: float = 0.1) -> DataFrame:
    """What each of runs(id, source_id, status, started_at, finished_at) did: its rows of fetches(run_id, canonical_url, ok), the share of failures, whether that is over the limit, and
    the exit code of its process: 0 for a success, 1 for anything else."""
    done = fetches.groupBy(F.col("run_id").alias("id")).agg(F.count_distinct("canonical_url").alias("urls"), F.count_if("ok").alias("fetched"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failures"))
    whole = runs.join(done, "id", "left").fillna(0, ["urls", "fetched", "failures"])
    ratio = F.when(F.col("fetched") + F.col("failures") > 0, F.col("failures") / (F.col("fetched") + F.col("failures"))).otherwise(F.lit(0.0))
    return whole.withColumn("failure_ratio", F.round(ratio, 6)).withColumn("over_limit", ratio > limit).withColumn("exit_code", F.when(F.col("status") == "succeeded", 0).otherwise(1))

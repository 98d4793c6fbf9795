"""Plans: what reaches the scan, what stays in the JVM, and what is shuffled."""

import pytest
from pyspark.sql import functions as F

from siltstone.plans.catalogue import QUERIES


def plan(spark, data, name):
    return QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["canonical_urls", "retry_plan", "token_counts", "sentence_units", "citations", "error_redaction", "utc_stamps", "short_documents", "request_checks"])
def test_row_by_row_queries_only_scan(spark, data, name):
    text = plan(spark, data, name)
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("name", ["catalog_upsert", "missing_runs", "soft_deletes", "stale_points", "context_budget", "prompt_blocks", "run_summary", "exact_duplicates", "chunk_overlap", "breadcrumbs", "deactivated_points", "needs_indexing"])
def test_relational_queries_stay_in_the_jvm(spark, data, name):
    text = plan(spark, data, name)
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize(("name", "wanted"), [("short_documents", "IsNotNull(text)"), ("retrieve_filtered", "In(label, [0,1,2])"), ("body_hashes", "IsNotNull(body)"), ("missing_runs", "EqualTo(status,succeeded)")])
def test_filters_reach_the_scan(spark, data, name, wanted):
    assert wanted in plan(spark, data, name)


@pytest.mark.parametrize(("name", "columns"), [("chunk_ids", "struct<chunk_id:string,source_id:string,canonical_url:string,chunk_index:int>"), ("media_types", "struct<content_type:string>"), ("distinct_documents", "struct<source_id:string,document_id:string>"), ("run_ledger", "struct<id:string,status:string,finished_at:timestamp>")])
def test_only_the_columns_needed_are_read(spark, data, name, columns):
    assert f"ReadSchema: {columns}" in plan(spark, data, name)


def test_robots_rules_are_judged_natively(spark, data):
    """Only the files go through Python; addresses do not."""
    text = plan(spark, data, "robots_permissions")
    assert text.count("ArrowEvalPython") == 1 and "startswith" in text.lower()


@pytest.mark.parametrize("name", ["needs_indexing", "points_by_document", "catalog_latest"])
def test_latest_rows_are_reduced_before_the_shuffle(spark, data, name):
    """The newest row of each key is a partial aggregate below the exchange, not a sort of the table."""
    text = plan(spark, data, name)
    assert "Window" not in text and text.count("partial_max") >= 1


def test_pages_of_a_small_file_are_made_and_read_by_all_tasks(spark, data):
    """Parts lie in one small file but make a page each: the rows are dealt before they are pages, whose bodies are not shuffled."""
    df = QUERIES["part_pages"](spark, data)
    assert df.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    below = df._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(p_partkey")[1]
    assert "encode" not in below and "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_type:string,p_size:int>" in below

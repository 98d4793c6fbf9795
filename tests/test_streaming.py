"""Streams over files that arrive in several micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from siltstone.operators import crawl
from siltstone.streaming import events, misses


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_misses(spark, tmp_path):
    schema = "source_id string, canonical_url string, run_no bigint, seen boolean"
    runs = [[("s", "a", 1, True), ("s", "b", 1, True)], [("s", "a", 2, False), ("s", "b", 2, True)], [("s", "a", 3, False), ("s", "a", 2, False)], [("s", "a", 4, True), ("s", "b", 4, False)]]
    want = [{"a": (0, False), "b": (0, False)}, {"a": (1, False), "b": (0, False)}, {"a": (2, True)}, {"a": (0, False), "b": (1, False)}]
    got = []
    for batch in runs:
        write(spark, batch, schema, tmp_path / "in")
        stream = misses.missing_state(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        keep = {}
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda df, n, keep=keep: keep.update({r.canonical_url: (r.misses, r.deleted) for r in df.collect()})).start()
        query.awaitTermination()
        got.append(keep)
    assert got == want


def test_late_rows_and_duplicates(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    at = dt.datetime(2026, 1, 1)
    row = lambda i, minutes: (i, at + dt.timedelta(minutes=minutes), 1, "view", 1.0)
    out, totals = str(tmp_path / "out"), []
    for batch in ([row(1, 0), row(1, 0), row(2, 5)], [row(3, 200), row(1, 1)], [row(4, 3), row(5, 400)], [row(6, 401)]):
        write(spark, batch, schema, tmp_path / "in")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        windows = events.windows(events.deduplicated(stream), "1 hour", None)
        windows.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        totals = {(r.window_start.hour, r.n) for r in spark.read.parquet(out).collect()}
    assert totals == {(0, 2), (3, 1)}  # the row of minute 3 came after the watermark; the last window is still open


def test_upserts(spark, tmp_path):
    """A stream that is stopped goes on with its state, also after the changes were folded and after a writer was lost."""
    schema, folder = "user_id bigint, event_id bigint, ts timestamp", f"{tmp_path}/state"
    batches = [[(1, 1, None), (1, 3, None), (2, 2, None)], [(1, 2, None), (3, 9, None)], [(2, 8, None)], [(2, 7, None), (4, 1, None)]]
    want = {}
    for n, batch in enumerate(batches):
        write(spark, batch, schema, tmp_path / "in")
        rows = events.event_stream(spark, str(tmp_path / "in")).select("user_id", "event_id").withColumn("order", F.col("event_id"))
        got = events.upserts(rows, ["user_id"], "order", folder, fold_after=3)
        want = {u: max(e, want.get(u, 0)) for u, e in [*want.items(), *((u, e) for u, e, _ in batch)] if e >= want.get(u, 0)}
        assert {(r.user_id, r.event_id) for r in got.collect()} == set(want.items())
        if n == 1:
            (tmp_path / "state" / "changes" / "000000000099").mkdir()


def test_complete_results_lie_in_the_folder(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    for n in (1, 2):
        write(spark, [(n, dt.datetime(2026, 1, 1, 3), 1, "view", 2.0)], schema, tmp_path / "in")
        got = events.run_to_table(events.windows(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "complete", f"{tmp_path}/out")
        assert [(r.n, r.total) for r in got.collect()] == [(n, 2.0 * n)]


def test_sitemap_indexes(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    pages = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    bodies = spark.createDataFrame([("r", index("a", "b", "r", "a")), ("a", pages("p1", "p2")), ("b", index("c", "d")), ("c", pages("p3")), ("d", pages("p4")), ("broken", "<x")], "url string, xml string")
    roots = spark.createDataFrame([("s", "r"), ("s", "r"), ("s", "gone"), ("s", "broken")], "source_id string, url string")
    assert {(r.sitemap, r.url) for r in crawl.expand_sitemaps(roots, bodies).collect()} == {("a", "p1"), ("a", "p2"), ("c", "p3"), ("d", "p4")}
    assert {r.url for r in crawl.expand_sitemaps(roots, bodies, children=3).collect()} == {"p1", "p2", "p3"}

"""Column functions against hand-made cases."""

import hashlib
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import http, ids, urls
from siltstone.functions import text as T
from siltstone.functions.vectors import cosine, unit


def one(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in row.items())).select(column.alias("x")).first()[0]


CANONICAL = {
    "https://Docs.Example.com:443/tutorial//first-steps/?utm_source=x#intro": "https://docs.example.com/tutorial/first-steps",
    "https://a.example/learn/thinking?foo=1&bar=2#hooks": "https://a.example/learn/thinking",
    "https://a.example/": "https://a.example/",
    "https://a.example": "https://a.example/",
    " https://a.example/x/// ": "https://a.example/x",
    "http://a.example:80/x": "http://a.example/x",
    "https://a.example:8443/x;p=1": "https://a.example:8443/x",
    "https://user:pw@a.example/x": "https://a.example/x",
    "https://a.example:bad/x": None,
    "https://a.example:70000/x": None,
    "/only/path": None,
    "": None,
    None: None,
}


def test_canonical_urls(spark):
    rows = spark.createDataFrame([(k,) for k in CANONICAL], "url string").select("url", urls.canonical_url(F.col("url")).alias("c")).collect()
    assert {r.url: r.c for r in rows} == CANONICAL
    assert one(spark, urls.canonical_url(F.col("u"), F.lit(True)), u="https://a.example/x/?b=1#c") == "https://a.example/x?b=1"


REASONS = {
    "https://docs.example/3/tutorial": "ok",
    "https://docs.example/3/tutorial/intro.html": "ok",
    "https://docs.example/3/tutorials": "invalid_path",
    "https://docs.example/exact": "ok",
    "https://docs.example/exact/below": "invalid_path",
    "https://docs.example/3/library/asyncio-task.html": "ok",
    "https://docs.example/3/library/asyncio.html": "ok",
    "https://docs.example/3/library/asyncio2.html": "invalid_path",
    "https://docs.example/3/library/": "ok",
    "https://docs.example/3/library/index.html": "ok",
    "https://docs.example/3/library/a/b": "invalid_path",
    "https://other.example/3/tutorial": "invalid_host",
    "http://docs.example/3/tutorial": "https_required",
    "ftp://docs.example/x": "unsupported_scheme",
    "https://user@docs.example/3/tutorial": "credentials_rejected",
    "https://docs.example:x/3/tutorial": "malformed_url",
    "no scheme": "malformed_url",
    "": "malformed_url",
    None: "malformed_url",
}


def test_url_reasons(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    reason = urls.url_reason(F.col("url"), a("docs.example"), a("/3/tutorial"), a("/exact"), a("asyncio"))
    rows = spark.createDataFrame([(k,) for k in REASONS], "url string").select("url", reason.alias("r")).collect()
    assert {r.url: r.r for r in rows} == REASONS


@pytest.mark.parametrize(("url", "child", "want"), [("https://d.example/sitemap.xml", False, "ok"), ("https://d.example/s2.xml", False, "invalid_path"), ("https://d.example/s2.xml", True, "ok"), ("https://d.example/Sitemap-2", True, "ok"), ("https://d.example/page", True, "invalid_path"), ("https://e.example/sitemap.xml", False, "invalid_host")])
def test_sitemap_and_robots(spark, url, child, want):
    hosts, maps = F.array(F.lit("d.example")), F.array(F.lit("https://D.example/sitemap.xml"))
    assert one(spark, urls.sitemap_reason(F.col("u"), hosts, maps, F.lit(child)), u=url) == want
    assert one(spark, urls.robots_reason(F.col("u"), hosts), u="https://d.example/robots.txt") == "ok"
    assert one(spark, urls.robots_reason(F.col("u"), hosts), u="https://d.example/x/robots.txt") == "invalid_robots_path"


def test_links(spark):
    rows = spark.createDataFrame([("https://a.example/x/", h) for h in ("../y", "#top", "mailto:a@b", "z.pdf", "Z.PNG?x=1", "https://b.example/c.js", "", "?q=1")], "base string, href string")
    rows = rows.withColumn("link", urls.resolve_url("base", "href")).where(urls.link_kept(F.col("href"), F.col("link")))
    assert {r.link for r in rows.collect()} == {"https://a.example/y", "https://a.example/x/?q=1"}


def test_ids(spark):
    h = hashlib.sha256(b"a" + b"https://u" + b"heading-v1" + b"0").hexdigest()
    assert one(spark, ids.chunk_id(F.col("s"), F.col("u"), F.lit(0)), s="a", u="https://u") == h
    assert one(spark, ids.document_id(F.col("s"), F.col("u")), s="a", u="é") == hashlib.sha256("a\né".encode()).hexdigest()
    raw = bytearray.fromhex(h)[:16]
    raw[6], raw[8] = (raw[6] & 15) | 128, (raw[8] & 63) | 128
    assert one(spark, ids.point_id(F.col("h")), h=h) == str(uuid.UUID(bytes=bytes(raw)))
    assert one(spark, ids.point_id(F.col("h")), h="abc") is None


def test_outcomes(spark):
    rows = [(200, "text/html; charset=x", 5, None, 1), (200, "image/png", 5, None, 1), (404, None, 0, None, 1), (410, None, 0, None, 1), (503, None, 0, None, 3), (403, None, 0, None, 1), (301, None, 0, None, 1), (None, None, 0, "timeout", 1), (None, None, 0, "timeout", 3), (200, "text/html", 6 << 20, None, 1)]
    df = spark.createDataFrame(rows, "s int, c string, n int, e string, a int").select(http.fetch_outcome(F.col("s"), F.col("c"), F.col("n"), F.col("e"), F.col("a")).alias("o")).select("o.*")
    assert [(r.status, r.reason) for r in df.collect()] == [("fetched", "ok"), ("skipped", "non_html"), ("gone", "http_404"), ("gone", "http_410"), ("failed", "retry_exhausted"), ("failed", "http_403"), ("redirect", "redirect"), ("failed", "timeout"), ("failed", "retry_exhausted"), ("skipped", "size_exceeded")]


def test_retry_after(spark):
    now = F.to_timestamp(F.lit("2026-08-29 12:00:00"))
    for value, want in (("9", 9.0), ("900", 60.0), ("Sat, 29 Aug 2026 12:00:30 GMT", 30.0), ("Sat, 29 Aug 2026 11:00:00 GMT", 0.0), ("soon", None), ("9" * 30, 60.0)):
        assert one(spark, http.retry_after_seconds(F.col("v"), now), v=value) == want
    assert [one(spark, http.backoff_seconds(F.col("n")), n=n) for n in (1, 2, 3, 20)] == [0.5, 1.0, 2.0, 60.0]


def test_headers(spark):
    df = spark.createDataFrame([({"Content-Type": "x", "Set-Cookie": "s", "Authorization": "t"},)], "h map<string,string>")
    assert df.select(http.safe_headers(F.col("h"))).first()[0] == {"content-type": "x"}


def test_sanitize(spark):
    assert one(spark, T.sanitize_error(F.col("m")), m="got Authorization: Bearer abc def") == "Error: got Authorization=<redacted>"
    assert one(spark, T.sanitize_error(F.col("m")), m="x?token=1&y=2 bearer zz") == "Error: x?token=<redacted>&y=2 Bearer <redacted>"
    assert one(spark, T.sanitize_error(F.col("m")), m="a" * 200) == "Error: " + "a" * 180 + "..."
    assert one(spark, T.sanitize_query(F.col("q")), q=" a\x00b​\nc ") == "ab\nc"
    assert one(spark, T.sanitize_query(F.col("q")), q="a" * 2001) == "a" * 2000 + " [query truncated]"
    assert one(spark, T.escape_delimiters(F.col("q")), q=T.BEGIN + "x" + T.END) == "[BEGIN_DOC]x[END_DOC]"


def test_breadcrumb_and_titles(spark):
    assert one(spark, T.breadcrumb(F.col("d"), F.col("t"), F.col("h")), d="Site", t=" A ", h=["A", "", "B"]) == "Site > A > B"
    assert one(spark, T.page_title(F.col("t"), F.lit("Site")), t="Page  one - Site") == "Page one"
    assert one(spark, T.page_title(F.col("t"), F.lit("Site")), t="Page | The Site Docs") == "Page"
    assert one(spark, T.page_title(F.col("t"), F.lit("Site")), t="Site") == "Site"
    assert one(spark, T.overlap_text(F.col("t"), 3), t="one two, three.") == ", three ."


FENCED = "a  \n\n\n\n\nb\n~~~x\n# no\n\n\n\n~~~~ \nc\n```\nopen\n"


def test_fences():
    assert T.fence_segments(FENCED) == [(False, "a  \n\n\n\n\nb"), (True, "~~~x\n# no\n\n\n\n~~~~ "), (False, "c"), (True, "```\nopen\n")]
    assert T.normal_form(FENCED) == "a\n\n\nb\n~~~x\n# no\n\n\n\n~~~~ \nc\n```\nopen"
    assert T.heading_outline("# A\n```\n# B\n```\n####### C\n## D ") == ["A", "D"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a#`~ \n\té", max_size=60))
def test_fence_segments_keep_the_text(text):
    assert "\n".join(s for _, s in T.fence_segments(text)) == text
    assert T.normal_form(T.normal_form(text)) == T.normal_form(text) or "`" in text or "~" in text


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(F.round(cosine(F.col("a"), F.col("b")), 9)).collect()] == [1.0, None]
    assert df.select(unit(F.col("a"))).first()[0] == pytest.approx([0.6, 0.8])

"""The HTTP source against a server on this machine, schemas, and whole pipelines."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.operators import crawl, pipeline
from siltstone.sources import html, http_source
from siltstone.sources.registry import registry


class Site(BaseHTTPRequestHandler):
    tries = {}

    def do_GET(self):
        n = Site.tries[self.path] = Site.tries.get(self.path, 0) + 1
        status, headers, body = 200, {"Content-Type": "text/html", "Set-Cookie": "secret"}, b"<p>x</p>"
        if self.path == "/flaky" and n < 3:
            status, headers = 503, {"Retry-After": "0"}
        elif self.path.startswith("/hop"):
            status, headers = 302, {"Location": f"/hop{int(self.path[4:]) + 1}" if self.path != "/hop2" else "/end"}
        elif self.path == "/loop":
            status, headers = 302, {"Location": "/loop"}
        elif self.path == "/away":
            status, headers = 302, {"Location": "http://elsewhere.example/"}
        elif self.path == "/large":
            body = b"x" * 5000
        elif self.path == "/down":
            status = 500
        self.send_response(status)
        for k, v in {**headers, "Content-Length": str(len(body))}.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Site.tries.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_source(spark, site):
    http_source.register(spark)
    urls = [f"{site}{p}" for p in ("/page", "/flaky", "/hop0", "/loop", "/away", "/large", "/down")] + ["https://127.0.0.1:1/x", "http://user@127.0.0.1/x"]
    options = {"urls": json.dumps(urls), "hosts": '["127.0.0.1"]', "schemes": '["http"]', "rps": "0", "cap": "1000", "pause_scale": "0.01"}
    got = {r.url.rpartition("/")[2]: r for r in spark.read.format("siltstone_http").options(**options).load().collect() if r.url.startswith(site)}
    assert (got["page"].http_status, bytes(got["page"].body), got["page"].attempts, got["page"].error_type) == (200, b"<p>x</p>", 1, None)
    assert "set-cookie" not in got["page"].headers and got["page"].headers["content-type"] == "text/html"
    assert (got["flaky"].http_status, got["flaky"].attempts) == (200, 3)
    assert (got["hop0"].http_status, got["hop0"].final_url) == (200, f"{site}/end")
    assert (got["loop"].error_type, got["away"].error_type, got["large"].error_type) == ("too_many_redirects", "rejected", "size_exceeded")
    assert (got["down"].http_status, got["down"].attempts) == (500, 3)


def test_what_the_reader_refuses(spark, site):
    http_source.register(spark)
    read = lambda urls, **o: {r.url.removeprefix(site): r.error_type for r in spark.read.format("siltstone_http").options(**{"urls": json.dumps([site + u for u in urls]), "schemes": '["http"]', "rps": "0", **o}).load().collect()}
    assert read(["/a", "/a/b", "/ab", "/away"], prefixes='["/a", "/away"]') == {"/a": None, "/a/b": None, "/ab": "rejected", "/away": "rejected"}
    assert read(["/a", "/p/x"], robots=json.dumps({"127.0.0.1": "User-agent: *\nDisallow: /p"})) == {"/a": None, "/p/x": "robots_disallowed"}
    assert read(["/a"], robots='{"127.0.0.1": null}') == {"/a": "robots_disallowed"}
    Site.tries.clear()
    assert read(["/loop"], kind="sitemap") == {"/loop": "too_many_redirects"} and Site.tries["/loop"] == 4


def test_crawl_drives_a_fetch(spark):
    web = {"/d/": "<a href='/d/a'>1</a><a href='/x'>2</a>", "/d/a": "<a href='b'>1</a><a href='./'>2</a><a href='http://s.example/d/z'>3</a>", "/d/b": "<a href='c#x'>1</a><a href='c'>2</a>", "/d/c": None}
    held = spark.createDataFrame([(f"https://s.example{u}".rstrip("/"), None if b is None else bytearray(b.encode())) for u, b in web.items()], "canonical_url string, body binary")
    sources = spark.createDataFrame([("s", ["S.example"], ["/d/"]), ("bad", ["s.example"], ["d"])], "source_id string, allowed_hosts array<string>, allowed_path_prefixes array<string>")
    seeds = spark.createDataFrame([("s", "https://s.example/d/"), ("bad", "https://s.example/d/"), ("s", "https://other.example/d")], "source_id string, url string")
    pages, found = crawl.crawl(seeds, sources, lambda level: level.join(held, "canonical_url", "left"))
    assert {(r.canonical_url.removeprefix("https://s.example"), r.level, r.discovered_from.removeprefix("https://s.example")) for r in found.collect()} == {("/d", 0, "seed"), ("/d/a", 1, "/d"), ("/d/b", 2, "/d/a"), ("/d/c", 3, "/d/b")}
    assert pages.count() == 4 and {r.source_id for r in pages.collect()} == {"s"}
    _, few = crawl.crawl(seeds, sources, lambda level: level.join(held, "canonical_url", "left"), cap=1)
    assert few.count() == 1


def test_crawl_over_http(spark, site):
    sources = spark.createDataFrame([("s", ["127.0.0.1"], ["/"])], "source_id string, allowed_hosts array<string>, allowed_path_prefixes array<string>")
    level = spark.createDataFrame([("s", f"{site}/page"), ("s", f"{site}/down")], "source_id string, canonical_url string")
    got = crawl.http_fetcher(schemes='["http"]', rps="0", pause_scale="0.01")(level).collect()
    assert {(r.canonical_url.removeprefix(site), r.body and bytes(r.body)) for r in got} == {("/page", b"<p>x</p>"), ("/down", None)} and sources.count() == 1


def test_registry(spark):
    rows = [("a", ["X.Example"], ["/", "/a/", "/b//"]), ("b", [], ["/"]), ("c", ["h"], ["x"]), ("d", None, None), ("e", ["h"], [None])]
    got = {r.source_id: (r.allowed_hosts, r.allowed_path_prefixes, r.invalid) for r in registry(spark.createDataFrame(rows, "source_id string, allowed_hosts array<string>, allowed_path_prefixes array<string>")).collect()}
    assert got == {"a": (["x.example"], ["/", "/a", "/b"], None), "b": ([], ["/"], "no_hosts"), "c": (["h"], ["x"], "relative_path"), "d": ([], [], "no_hosts"), "e": (["h"], [None], "relative_path")}


def test_schemas(spark, data):
    for name in schemas.DDL:
        df = spark.read.parquet(f"{data}/{name}.parquet")
        assert set(schemas.schema(name).names) == set(df.columns), name
        assert schemas.mismatches(df, name) == [], name
    old = spark.createDataFrame([("1", "s")], "id string, source_id string")
    assert schemas.migrate(schemas.migrate(old, "ingestion_runs"), "ingestion_runs").first().asDict() == {"id": "1", "source_id": "s", "status": None, "started_at": None, "finished_at": None, "error_type": None, "error_message": None}


def test_plain_pages_are_read_as_by_the_standard_reader():
    """Where the quick reader gives a tree, it is the standard one; it gives one for plain pages, and none for others."""
    show = lambda e: (e.name, list(e.attrs.items()), [c if isinstance(c, str) else show(c) for c in e.children])

    def standard(page):
        builder = html._Builder()
        builder.feed(page)
        builder.close()
        return show(builder.root)

    plain = ("<!DOCTYPE html><TITLE>a &amp; b</TITLE >x", "a &amp;lt; &copy; &", "<P Class=a id='x>y' b href=\"/q?a&amp;b\" b=2>t<br/><b />u</i></P>v", "<script a>if (a<b) '&amp;'</Script><style></style >x", "<!-- a-b --><td><tr\n>")
    other = ("<a href=x/>t", "<a b= c>", "<a b='c'd>", "a < b", "</>", "<!-->x-->", "<![CDATA[x]]>", "<title><b>x</b></title>", "<script>'</b>'</script>", "<script>x", "<textarea><p></textarea>", "<a", "</a b>")
    for page in plain + other:
        tree = html.quick(page)
        assert tree is None or show(tree) == standard(page), page
        assert show(html.parse(page)) == standard(page), page
    assert all(map(html.quick, plain)) and not any(map(html.quick, other))


def test_selectors():
    root = html.parse("<div class='a b' id=x data-k='v w'><p class=b><i>1</i></p></div><p class=b>2</p>")
    found = lambda s: [e.text() for e in html.select(root, s)]
    assert (found("p.b"), found("div p"), found("#x .b i"), found("[data-k]"), found("[data-k='v w'].a"), found("p > i"), found("")) == (["1", "2"], ["1"], ["1"], ["1"], ["1"], [], [])


def test_answers(spark):
    requests = spark.createDataFrame([(1, "q", 10, 0.5, 5, 100), (2, " ", 10, 0.5, 5, 100), (3, "q", 10, 0.99, 5, 100), (4, "q", 1, 0.0, 5, 100), (5, "q", 10, 0.0, 1, 100), (6, "q", 0, 0.0, 1, 1)], "request_id int, query string, top_k int, score_threshold double, max_chunks int, token_budget int")
    hits = [(r, n, s, f"c{n}", "s", "d", f"https://u/{n}", "t", "b", "words here") for r in range(1, 7) for n, s in ((1, 0.9), (2, 0.6), (3, 0.3))]
    hits += [(1, 4, 0.8, "c1", "s", "d", "https://u/1", "t", "b", "words here")]
    df = spark.createDataFrame(hits, "request_id int, rank int, score double, chunk_id string, source_id string, document_id string, canonical_url string, title string, breadcrumb string, text string")
    got = {r.request_id: r for r in pipeline.answers(requests, df, lambda p, c: F.concat(F.get(c, F.lit(0))["canonical_url"], F.lit(", https://z"))).collect()}
    assert (got[1].n_chunks, got[1].citations, got[1].n_fabricated, got[1].context_tokens) == (2, ["https://u/1"], 1, 4)
    assert (got[2].error_type, got[2].answer, got[6].error_type) == ("blank_query", None, "top_k")
    assert got[3].context_was_empty and got[3].answer is None and json.loads(got[3].response)["ok"]
    assert (got[4].n_chunks, got[5].n_chunks, got[5].n_truncated) == (1, 1, 2)


def test_index_refresh(spark):
    from siltstone.operators import chunking, index

    docs = spark.createDataFrame([("d", "s", "Site", "https://u", "T", "# T\n\n" + "word " * 500, "h")], "document_id string, source_id string, display_name string, canonical_url string, title string, extracted_text string, extracted_sha256 string")
    chunks = chunking.chunk_documents(docs)
    embed, at = pipeline.hash_embedder(8), F.to_timestamp(F.lit("2026-01-01"))
    points = index.points_from_chunks(chunks, embed, "r1", "m", at)
    after, counts = pipeline.refresh_index(points, chunks.where("chunk_index = 0"), embed, "r2", "m", at)
    assert {(r.chunk_index, r.is_active, r.ingestion_run_id) for r in after.collect()} == {(0, True, "r2"), (1, False, "r1")}
    assert [tuple(r) for r in counts.select("document_id", "deactivated", "upserted").collect()] == [("d", 1, 1)]
    assert index.stale_points(points, chunks.where("chunk_index = 0")).count() == 1

"""Core operators on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone import session
from siltstone.functions import text as T
from siltstone.operators import catalog, chunking, crawl, html_extract, incremental, index, retrieval, snapshots
from siltstone.operators.store import VectorStore
from siltstone.sources import html

AT = dt.datetime(2026, 8, 29, 12)
PAGE = """<html><head><title>Page - Site</title></head><body><nav>menu</nav><main><h1>Title</h1><p>Text &amp; <b>bold</b> <a href="/x">link</a> <a href="#y">local</a>
<code>f()</code></p><ul><li>one<ul><li>inner</li></ul></li><li>two</li></ul><pre class="language-py"><code>
x = 1
```
</code></pre><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><blockquote><p>q</p></blockquote><!-- gone --><img alt="pic"></main><footer>end</footer></body></html>"""


def test_extraction():
    reason, title, text, outline = html_extract.extract(PAGE.encode())
    assert (reason, title, outline) == ("too_short", "Page - Site", ["Title"])
    assert text == "# Title\n\nText & bold [link](/x) local\n`f()`\n\n- one\n  - inner\n- two\n\n````py\nx = 1\n```\n````\n\nA | B\n1 | 2\n\n> q\n\npic"
    assert html_extract.extract(None)[0] == "empty" and html_extract.extract(b" ")[0] == "empty"
    assert html_extract.extract(b"<body><div>x</div></body>")[0] == "extract_failed"
    assert html_extract.extract(b"<main><p>" + b"word " * 60)[0] == "ok"


def test_each_element_is_asked_once_for_all_selectors(monkeypatch):
    """Junk and the main element are found in one walk, however many selectors there are; what lies in junk is not looked at."""
    asked, first = [], html.Selectors.first
    monkeypatch.setattr(html.Selectors, "first", lambda self, e: asked.append((id(self), e.name)) or first(self, e))
    page = "<nav><i>1</i></nav><article><p>a</p><button><u>2</u></button><div class='x copy'>3</div><b class=x>b</b></article>"
    assert html_extract.extract(page)[2] == "a\n\nb"
    assert len(asked) == len(set(asked)) and {name for _, name in asked} == {"nav", "article", "p", "button", "div", "b"}


def test_junk_in_titles():
    """A title in junk is the title still; what was named by a selector before that junk is not in it."""
    root = html.parse("<svg></svg>")
    title = html.Element("title", {}, root.children[0])
    root.children[0].children.append(title)
    for name, text in (("script", "1"), ("svg", "2"), ("button", "3"), ("b", "4")):
        e = html.Element(name, {}, title)
        e.children.append(text)
        title.children.append(e)
    assert html_extract.title_text(root, html_extract.Selectors((*html_extract.STRIPPED_TAGS, *html_extract.STRIPPED))) == "34"


def test_deep_pages_and_nested_lists():
    deep = b"<main>" + b"<div><b>" * 20000 + b"<p>" + b"text " * 60 + b"</main>"
    assert html_extract.extract(deep)[2] == ("text " * 60).strip()
    nested = "<main><ol><li>a<ul><li>b<pre>x</pre></li><li> </li></ul></li><li></li><li>c <a href='/u'>d <b>e</b></a><br>f</li></ol><p>g<ul><li>h</li></ul></p><li>i</li></main>"
    assert html_extract.extract(nested)[2] == "1. a\n  - b```\n  x\n  ```\n2. c [d e](/u)\nf\n\ngh\n\ni"
    assert html_extract.language(html_extract.parse("<pre class='x lang-C++ py'></pre>").find("pre")) == "c++"


def test_text_is_decoded_twice_but_for_code_blocks():
    page = "<main><h1>&amp;lt;</h1><p>&amp;lt;a <code>&amp;amp;</code></p>&amp;gt;<pre>&amp;lt;</pre><table><tr><td>&amp;lt;</td></tr></table></main>"
    assert html_extract.extract(page)[2] == "# &lt;\n\n<a `&`\n\n>```\n&lt;\n```\n\n&lt;"


def test_selectors_of_a_source(spark):
    body = bytearray(b"<main><p>" + b"main text " * 30 + b"</p></main><div id=own><p>" + b"own text " * 30 + b"</p><em>x</em></div>")
    df = spark.createDataFrame([(1, "a", "u", body), (2, "b", "u", body)], "record_id bigint, source_id string, canonical_url string, body binary")
    got = {r.record_id: r.extracted_text for r in html_extract.extract_pages(df, {"b": (("#own",), ("em",))}).collect()}
    assert got[1] == ("main text " * 30).strip() and got[2] == ("own text " * 30).strip()


def test_titles(spark):
    rows = [("# A b \nx", "p", "A b"), ("\n## Sub\n\n# Main", "p", "Main"), ("text\n# A", " p ", "p"), ("## only", "p", "p"), ("#no\n# yes", "p", "yes"), (None, "p", "p"), ("", None, ""), ("# ", "p", "")]
    df = spark.createDataFrame(rows, "text string, page string, want string")
    assert all(r.got == r.want for r in df.select("want", T.document_title(F.col("text"), F.col("page")).alias("got")).collect())


def test_replies(spark):
    rows = [(200, '{"choices":[{"message":{"content":"hi"}}]}', "hi", None), (200, '{"choices":[]}', None, "malformed_response"), (200, "x", None, "malformed_response"), (200, '{"choices":[{"message":{"content":" \\n"}}]}', None, "malformed_response"), (429, "{}", None, "rate_limited"), (500, "{}", None, "provider_error"), (None, None, None, "provider_error")]
    text, error = T.reply_text(F.col("status"), F.col("body"))
    assert [(r.text, r.error) for r in spark.createDataFrame(rows, "status int, body string, a string, b string").select(text.alias("text"), error.alias("error")).collect()] == [r[2:] for r in rows]
    assert spark.range(1).select(T.system_prompt()).first()[0].count("\n") == 6


def test_chunk_limits():
    long = " ".join(f"tok{i}" for i in range(700))
    assert [(chunking.tokens(p), n) for p, n in chunking.cut_section(long)] == [(400, 400), (300, 300)]
    fence = "```\n" + "\n".join(f"line {i} x" for i in range(200)) + "\n```"
    assert [p for p, _ in chunking.cut_section(f"intro\n\n{fence}\n\nend")] == ["intro", fence, "end"]
    assert chunking.units("# A\n\n## B\n\ntext\n\n# C\n```\nx\n```") == [(False, "# A\n\n## B\n\ntext"), (False, "# C"), (True, "```\nx\n```")]
    assert list(chunking.sections("# A\na\n## B\nb\n# C\n```\n# no\n```")) == [(["A"], "# A\na"), (["A", "B"], "## B\nb"), (["C"], "# C\n```\n# no\n```")]


def test_chunks(spark):
    text = "# A\n\n" + " ".join(f"Word{i} goes here." for i in range(150)) + "\n\n## B\n\nshort"
    rows = spark.createDataFrame([("d", "s", "Site", "https://u", "A", text, "h"), ("e", "s", "Site", "https://v", "", None, None), ("f", "s", "Site", "https://w", "", "", None)], "document_id string, source_id string, display_name string, canonical_url string, title string, extracted_text string, extracted_sha256 string")
    got = chunking.chunk_documents(rows).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and len(got) >= 3 and len({r.chunk_id for r in got}) == len(got)
    assert all(chunking.tokens(r.primary_text) <= 400 and r.token_count == chunking.tokens(r.text) for r in got)
    assert got[-1].breadcrumb == "Site > A > B" and got[-1].headings == ["A", "B"]
    tail = " ".join(chunking.TOKEN.findall(got[0].primary_text)[-50:])
    assert got[1].text == f"{got[1].breadcrumb}\n{tail}\n{got[1].primary_text}"


COLUMNS = "source_id string, canonical_url string, updated_at timestamp, is_in_corpus int, duplicate_of string, extracted_sha256 string, chunker_version string, indexed_sha256 string, indexed_chunker_version string"


def page(url, day=1, corpus=1, dup=None, e="aa", v="1", i=None, w=None, source="s"):
    return (source, url, None if day is None else AT + dt.timedelta(days=day), corpus, dup, e, v, i, w)


def found(df, state):
    return {r.canonical_url for r in incremental.pending_since(df, state, 8).collect()}


def test_pending_pages(spark, tmp_path):
    rows = [
        page("new"), page("done", i="AA ", w=" 1"), page("old version", i="aa", w="0"), page("out", corpus=0), page("copy", dup="x"), page("blank copy", dup=" "), page("empty hash", e=" "), page("null hash", e=None),
        page("later done", day=1), page("later done", day=2, i="aa", w="1"), page("later open", day=3, e="bb", i="aa", w="1"), page("later open", day=2, i="aa", w="1"), page("undated", day=None), page("undated", i="aa", w="1"),
        page("no version", v=None, i="aa", w=None), page("null corpus", corpus=None), page("new"), page(None), page("no source", source=None),
    ]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("part", F.lit("x")).withColumn("row", F.lit(1)).withColumn("marker", F.lit(2))
    assert found(df, f"{tmp_path}/state") == {"new", "old version", "blank copy", "later open", "no version"}


def test_incremental_runs(spark, tmp_path):
    state = f"{tmp_path}/state"
    first = spark.createDataFrame([page(f"u{i}") for i in range(40)], COLUMNS)
    assert found(first, state) == {f"u{i}" for i in range(40)}
    before = {str(p) for p in (tmp_path / "state/result").rglob("*.parquet")}
    assert found(first, state) == {f"u{i}" for i in range(40)}  # nothing changed: nothing is written
    assert {str(p) for p in (tmp_path / "state/result").rglob("*.parquet")} == before
    second = first.unionByName(spark.createDataFrame([page("u3", day=2, i="aa", w="1")], COLUMNS))
    assert found(second, state) == {f"u{i}" for i in range(40)} - {"u3"}
    after = {str(p) for p in (tmp_path / "state/result").rglob("*.parquet")}
    assert before - after and before & after  # one partition was replaced, the others stayed
    assert found(second.where("canonical_url != 'u5'"), state) == {f"u{i}" for i in range(40)} - {"u3", "u5"}
    assert found(second.where("false"), state) == set()


def test_a_failed_run_is_repeated(spark, tmp_path, monkeypatch):
    """Runs that stop at any step, followed by runs over tables that have lost rows or are as they were."""
    state = f"{tmp_path}/state"
    whole, few = (spark.createDataFrame([page(f"u{i}") for i in range(n)], COLUMNS) for n in (14, 2))
    assert found(few, state) == {"u0", "u1"}
    write = incremental.snapshots.commit
    for fail_at in (0, 1):  # before the result is written, and between it and the fingerprints
        done = []

        def failing(*args, done=done, fail_at=fail_at):
            if len(done) == fail_at:
                raise OSError("lost")
            done.append(write(*args))

        with monkeypatch.context() as m:
            m.setattr(incremental.snapshots, "commit", failing)
            with pytest.raises(OSError, match="lost"):
                found(whole, state)
        assert found(few, state) == {"u0", "u1"}  # the run's rows have vanished, and nothing of it is handed on
    with monkeypatch.context() as m:
        m.setattr(incremental, "record", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            found(few.where("false"), state)
    assert found(whole, state) == {f"u{i}" for i in range(14)}
    assert incremental.pending_since(whole, state, 8).count() == 14


def test_a_state_that_is_not_recorded_at_all(spark, tmp_path, monkeypatch):
    state = f"{tmp_path}/state"
    df = spark.createDataFrame([page(f"u{i}") for i in range(14)], COLUMNS)
    with monkeypatch.context() as m:
        m.setattr(incremental, "record", lambda *a: None)
        found(df, state)
    assert found(df.where("canonical_url < 'u11'"), state) == {"u0", "u1", "u10"}


def test_another_number_of_partitions(spark, tmp_path):
    state = f"{tmp_path}/state"
    df = spark.createDataFrame([page(f"u{i}") for i in range(30)], COLUMNS)
    for partitions in (8, 64, 16, None, None):
        assert {r.canonical_url for r in incremental.pending_since(df, state, partitions).collect()} == {f"u{i}" for i in range(30)}
    assert incremental.partitions_for(0) == incremental.FEWEST and incremental.partitions_for(10**13) == incremental.MOST
    assert incremental.partitions_for(50_000_000) == 512


def test_a_run_over_one_source_leaves_the_others_partitions(spark, tmp_path):
    state = f"{tmp_path}/state"
    df = spark.createDataFrame([page(f"u{i}", source=f"s{i % 9}") for i in range(200)], COLUMNS)
    assert incremental.pending_since(df, state).count() == 200
    more = df.unionByName(spark.createDataFrame([page(f"n{i}", source="s1") for i in range(100)], COLUMNS))
    change = incremental.changes(more, incremental.PAGE_KEY, incremental.PAGE_COLUMNS, state, None, ["source_id"])
    assert 0 < len(change.parts) <= incremental.SPREAD < change.partitions
    assert incremental.pending_since(more, state).count() == 300


def test_fingerprints_do_not_depend_on_order(spark):
    rows = [page(f"u{i % 7}", day=i) for i in range(30)]
    part = incremental.bucket(incremental.PAGE_KEY, 4)
    prints = [sorted(map(tuple, incremental.fingerprints(spark.createDataFrame(r, COLUMNS), part, incremental.PAGE_COLUMNS, 4).collect())) for r in (rows, rows[::-1])]
    assert prints[0] == prints[1]


def test_catalog(spark):
    old = spark.createDataFrame([("s", "a", "seed", "fetched", 2, "r0", "r0", 1, 0, AT), ("s", "b", None, "pending", 0, None, None, 0, 1, AT)], "source_id string, canonical_url string, discovered_from string, fetch_status string, attempt_count int, last_seen_run_id string, last_touched_run_id string, consecutive_missing_success_runs int, is_in_corpus int, updated_at timestamp")
    new = spark.createDataFrame([("s", "a", "r1", "x", AT), ("s", "c", "r1", "y", AT), ("s", "c", "r1", "z", AT - dt.timedelta(1))], "source_id string, canonical_url string, run_id string, discovered_from string, at timestamp")
    got = {r.canonical_url: r for r in catalog.register(old, new).collect()}
    assert (got["a"].discovered_from, got["a"].fetch_status, got["a"].consecutive_missing_success_runs, got["a"].is_in_corpus, got["a"].last_seen_run_id) == ("seed", "fetched", 0, 1, "r1")
    assert (got["b"].last_seen_run_id, got["c"].discovered_from, got["c"].fetch_status) == (None, "z", "pending")
    missed = catalog.soft_delete(catalog.count_missing(old, spark.createDataFrame([("s", "r1")], "source_id string, run_id string")))
    assert {(r.canonical_url, r.misses, r.newly_deleted, r.deleted) for r in missed.collect()} == {("a", 1, False, True), ("b", 1, False, False)}


def outcome(url, minutes, ok, status=None, http=None, etag=None, error=None, run="r2"):
    at = None if minutes is None else AT + dt.timedelta(minutes=minutes)
    return ("s", url, run, ok, status, http, etag, None, "text/html", 10, "h", error, error and f"{error}!", at)


def test_fetches_are_folded_in_order(spark):
    old = spark.createDataFrame([("s", u, "fetched", 2, 200, "e0", "x", AT, "mine") for u in "abcdef"], "source_id string, canonical_url string, fetch_status string, attempt_count int, http_status int, etag string, error_type string, last_success_at timestamp, more string")
    schema = "source_id string, canonical_url string, run_id string, ok boolean, status string, http_status int, etag string, last_modified string, content_type string, size_bytes int, content_sha256 string, error_type string, error_message string, at timestamp"
    rows = [
        outcome("a", 1, False, "failed", None, error="timeout"), outcome("a", 2, True, "fetched", 200, "e1"),  # success last
        outcome("b", 1, True, "fetched", None, "e2"), outcome("b", 2, False, None, None, error="timeout"),  # failure last: validators of the success, its empty HTTP status too
        outcome("c", 1, False, "gone", 404, error="gone"), outcome("c", 3, False, None, None, error="x"),  # the status known before is kept
        outcome("d", None, True, "fetched", 200, "e3"), outcome("d", 1, False, "skipped", 500), outcome("e", None, False, None, None), outcome("zzz", 1, True),
    ]
    got = {r.canonical_url: r for r in catalog.record_fetches(old, spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == set("abcdef") and {r.more for r in got.values()} == {"mine"}
    pick = lambda u: (got[u].attempt_count, got[u].fetch_status, got[u].http_status, got[u].etag, got[u].error_type, got[u].last_success_at)
    assert pick("a") == (4, "fetched", 200, "e1", None, AT + dt.timedelta(minutes=2))
    assert pick("b") == (4, "failed", None, "e2", "timeout", AT + dt.timedelta(minutes=1))
    assert pick("c") == (4, "failed", 404, "e0", "x", AT)
    assert pick("d") == (4, "skipped", 500, "e3", None, AT) and pick("e") == (3, "failed", 200, "e0", None, AT) and pick("f") == (2, "fetched", 200, "e0", "x", AT)
    assert got["b"].content_sha256 == "h" and got["f"].content_sha256 is None and got["c"].error_message == "x!"


def test_extractions_and_indexing(spark):
    old = spark.createDataFrame([("s", "a", "h0", "v0", "d", None, None), ("s", "b", None, None, None, "h", "v")], "source_id string, canonical_url string, extracted_sha256 string, chunker_version string, duplicate_of string, indexed_sha256 string, indexed_chunker_version string")
    rows = spark.createDataFrame([("s", "a", "r1", "h1", "v1", "dup", AT), ("s", "a", "r2", "h2", "v1", None, AT + dt.timedelta(1)), ("s", "a", "r3", "h3", "v1", "y", None)], "source_id string, canonical_url string, run_id string, extracted_sha256 string, chunker_version string, duplicate_of string, at timestamp")
    got = {r.canonical_url: r for r in catalog.record_indexing(catalog.record_extractions(old, rows), rows.where("run_id = 'r1'")).collect()}
    a, b = got["a"], got["b"]
    assert (a.extracted_sha256, a.chunker_version, a.duplicate_of, a.indexed_sha256, a.indexed_chunker_version, a.last_touched_run_id, a.updated_at) == ("h2", "v1", None, "h1", "v1", "r1", AT + dt.timedelta(1))
    assert (b.extracted_sha256, b.indexed_sha256, b.last_touched_run_id) == (None, "h", None)


def test_misses_are_added(spark):
    old = spark.createDataFrame([("s", "a", 1), ("s", "b", None), ("s", "c", 4)], "source_id string, canonical_url string, consecutive_missing_success_runs int")
    rows = spark.createDataFrame([("s", "a", "r1", AT), ("s", "a", "r2", AT + dt.timedelta(1)), ("s", "b", "r1", None)], "source_id string, canonical_url string, run_id string, at timestamp")
    got = catalog.record_misses(old, rows).collect()
    assert {(r.canonical_url, r.consecutive_missing_success_runs, r.last_touched_run_id) for r in got} == {("a", 3, "r2"), ("b", 1, "r1"), ("c", 4, None)}


def test_transactions(spark, tmp_path):
    folder, one = str(tmp_path / "t"), spark.range(1)
    t = snapshots.Transaction(spark, folder)
    with pytest.raises(RuntimeError):
        t.put("a", one)
    with pytest.raises(FileNotFoundError):
        t.get("a")
    with t:
        t.put("a", one)
        with t:  # ends with the outer one
            t.put("b", spark.range(2))
        assert t.paths() == {} and t.get("b").count() == 2
    assert set(t.paths()) == {"a", "b"}
    with pytest.raises(ValueError), t:
        t.put("a", spark.range(9))
        with t:
            raise ValueError
    with pytest.raises(RuntimeError), t:
        t.put("a", spark.range(9))
        try:
            with t:
                raise ValueError
        except ValueError:
            pass
    assert t.get("a").count() == 1 and len(list((tmp_path / "t/tables").iterdir())) == 2
    with t:
        t.put("a", t.get("a").union(one))
    assert snapshots.Transaction(spark, folder).get("a").count() == 2 and t.get("b").count() == 2


def test_runs_and_snapshots(spark, tmp_path):
    runs = spark.createDataFrame([("1", "s", AT, "started", None, None), ("2", "s", AT, "failed", AT, "x")], "id string, source_id string, started_at timestamp, status string, finished_at timestamp, error_message string")
    opened = catalog.open_runs(runs, spark.createDataFrame([("2", "s", AT), ("3", "t", AT)], "id string, source_id string, started_at timestamp"))
    assert {(r.id, r.status) for r in opened.collect()} == {("1", "started"), ("2", "failed"), ("3", "started")}
    report = catalog.run_report(opened, spark.createDataFrame([("1", "u", True), ("1", "u", False), ("9", "u", True)], "run_id string, canonical_url string, ok boolean"))
    assert {(r.id, r.urls, r.fetched, r.failures, r.over_limit, r.exit_code) for r in report.collect()} == {("1", 1, 1, 1, True, 1), ("2", 0, 0, 0, False, 1), ("3", 0, 0, 0, False, 1)}
    ends = spark.createDataFrame([("1", True, AT, None), ("2", True, AT, None)], "id string, succeeded boolean, finished_at timestamp, error_message string")
    assert {(r.id, r.status, r.rejected) for r in catalog.finish_runs(runs, ends).collect()} == {("1", "succeeded", False), ("2", "failed", True)}
    assert not snapshots.exists(spark, str(tmp_path), "runs")
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, str(tmp_path), "runs")
    first = snapshots.commit(runs, str(tmp_path), "runs")
    reader = snapshots.current(spark, str(tmp_path), "runs")
    second = snapshots.commit(runs.where("id = '2'"), str(tmp_path), "runs")
    assert snapshots.current(spark, str(tmp_path), "runs").count() == 1 and reader.count() == 2  # who read the version before can go on
    half = tmp_path / "runs" / "000000000009-x"
    half.mkdir()  # a writer that was lost
    assert snapshots.versions(spark, str(tmp_path), "runs") == [first, second]
    third = snapshots.commit(runs, str(tmp_path), "runs")
    assert snapshots.versions(spark, str(tmp_path), "runs") == [second, third] and not half.exists()


def test_staged_tables_are_released(spark):
    rows = session.stage(spark.range(3).toDF("id"), "some")
    assert rows.count() == 3 and session.release(spark) >= 1 and session.release(spark) == 0


def test_context(spark):
    hits = F.array(*(F.struct(F.lit(c).alias("chunk_id"), F.lit(n).alias("tokens")) for c, n in (("a", 3), ("b", 9), ("c", 2), ("d", 4))))
    p = spark.range(1).select(retrieval.pack_context(hits, 5, 6).alias("p")).first().p
    assert (p.kept, p.truncated, p.total) == (["a", "c"], ["b", "d"], 5)
    p = spark.range(1).select(retrieval.pack_context(hits, 2, 100).alias("p")).first().p
    assert (p.kept, p.truncated) == (["a", "b"], ["c", "d"])


def test_redundant(spark):
    long = "word " * 60
    rows = [(1, "s", "d", "u", long), (2, "s", "d", "u", long.replace("word ", "word  ", 1)), (3, "s", "d", "u", "short"), (4, "s", "d", "u", "short"), (5, "s", "e", "u", long), (6, "s", "d", "u", None)]
    df = spark.createDataFrame([("q", *r) for r in rows], "q string, n int, source_id string, document_id string, canonical_url string, text string")
    assert {r.n for r in retrieval.without_redundant(df, "q", [F.col("n")]).collect()} == {1, 3, 4, 5, 6}


def test_citations(spark):
    answer = "See https://a.example/x, https://a.example/x. (https://b.example/y) http://a.example/z and https://c.example!"
    cited, other = retrieval.citations(F.lit(answer), F.array(F.lit("https://a.example/x"), F.lit("https://d.example")))
    assert tuple(spark.range(1).select(cited, other).first()) == (["https://a.example/x"], 2)


def test_search(spark):
    df = spark.createDataFrame([(i, [float(i % 3 == j) for j in range(3)]) for i in range(7)] + [(9, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, None)], "vec_id bigint, embedding array<double>")
    got = retrieval.search(df.where("vec_id < 2"), df, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.point_id, r.score) for r in got] == [(0, 0, 1.0), (0, 3, 1.0), (1, 1, 1.0), (1, 4, 1.0)]


def test_search_in_groups(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], "ab"[i % 2]) for i in range(9)] + [(20, [1.0, 1.0], None)], "vec_id bigint, embedding array<double>, source string")
    got = retrieval.search(df.where("vec_id in (2, 3, 20)"), df, 2, group="source").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.point_id) for r in got] == [(2, 2), (2, 4), (3, 3), (3, 5)]
    hit = spark.createDataFrame([("p", None, None, None, 0.5)], "point_id string, chunk_id string, headings array<string>, title string, score double")
    assert tuple(retrieval.with_defaults(hit).first()) == ("p", "p", [], "", 0.5)


def test_points(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], True), ("b", None, True), ("c", [3.0, 4.0], None)], "point_id string, vector array<double>, is_active boolean")
    assert index.require_dimension(df, 2).count() == 3 and len(index.require_dimension(df, 2).collect()) == 3
    with pytest.raises(Exception, match="a vector must have 3 numbers, not 2"):
        index.require_dimension(df, 3).collect()
    assert {(r.point_id, r.is_active) for r in index.set_active(df, df.where("point_id != 'b'"), False).collect()} == {("a", False), ("b", True), ("c", False)}


def test_vector_store(spark, tmp_path):
    at = VectorStore(spark, f"{tmp_path}/store", dim=2)
    row = lambda i, v, source="s", chunk=None, day=0: (i, v, source, f"d{i}", chunk or f"c{i}", True, AT + dt.timedelta(days=day))
    points = lambda rows: spark.createDataFrame(rows, "point_id string, vector array<float>, source_id string, document_id string, chunk_id string, is_active boolean, created_at timestamp")
    assert at.points().count() == 0
    at.upsert(points([row("a", [1.0, 0.0]), row("a", [0.0, 1.0], day=-1), row("b", [1.0, 0.1]), row("c", [1.0, 0.2], source="t"), row("e", [0.9, 0.0], chunk="ca")]))
    ask = spark.createDataFrame([(1, [1.0, 0.0], "s")], "vec_id bigint, vector array<float>, source_id string")
    found = lambda **o: [r.point_id for r in at.search(ask, 3, **o).orderBy("rank").collect()]
    assert found() == ["a", "b"] and found(by_source=True) == ["a", "b"]  # e is another point of a's chunk
    at.upsert(points([row("a", [0.0, 1.0])]))
    assert found() == ["e", "b", "c"] and found(threshold=0.99) == ["e", "b"] and found(by_source=True)[:2] == ["e", "b"]
    at.set_active(spark.createDataFrame([("e",)], "point_id string"), False)
    at.deactivate(spark.createDataFrame([("db",), ("none",)], "document_id string"))
    assert found() == ["c", "a"] and at.of_documents(spark.createDataFrame([("db",)], "document_id string")).first().is_active is False and at.points().count() == 4
    first = at.search(ask, 1).first()
    assert (first.title, first.headings, first.chunk_index) == ("", [], 0)
    with pytest.raises(Exception, match="a vector must have 2 numbers, not 3"):
        at.upsert(points([row("z", [1.0, 2.0, 3.0])]))
    assert at.points().count() == 4


def test_crawl(spark):
    pages = spark.createDataFrame([("s", "https://a.example/x/", b'<a href="y">1</a><a href="y#f">2</a><a href="#z">3</a><a>4</a><a href="q.pdf">5</a>'), ("s", "https://a.example/", None)], "source_id string, page_url string, body binary")
    assert {r.link for r in crawl.page_links(pages).collect()} == {"https://a.example/x/y", "https://a.example/x/y#f"}
    xml = ["<urlset xmlns='x'><url><loc> a </loc></url></urlset>", "<sitemapindex><sitemap><loc>b</loc></sitemap></sitemapindex>", "<other/>", "<broken", None, "<other><loc>c</loc></other>"]
    got = spark.createDataFrame([(x,) for x in xml], "x string").select(crawl.parse_sitemap("x").alias("s")).select("s.*").collect()
    assert [(r.ok, r.is_index, r.urls) for r in got] == [(True, False, ["a"]), (True, True, ["b"]), (False, False, []), (False, False, []), (False, False, []), (True, False, ["c"])]
    robots = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /p"), ("b", 404, None), ("c", 500, None)], "host string, status int, body string")
    asked = spark.createDataFrame([("a", "https://a/p/1"), ("a", "https://a/q"), ("b", "https://b/p"), ("c", "https://c/p"), ("d", "https://d/")], "host string, url string")
    assert {(r.url, r.allowed) for r in crawl.robots_allowed(asked, robots, "bot").collect()} == {("https://a/p/1", False), ("https://a/q", True), ("https://b/p", True), ("https://c/p", False), ("https://d/", False)}
    more = spark.createDataFrame([("a", 200, "User-agent: bot\nAllow: /p/ok\nDisallow: /p\nDisallow: /a%20b\n\nUser-agent: *\nDisallow: /"), ("b", 200, "x" * (crawl.MAX_ROBOTS + 1)), ("c", 200, None), ("d", 200, "User-agent: *\nDisallow:"), ("e", 200, "User-agent: other\nDisallow: /"), ("f", None, None)], "host string, status int, body string")
    urls = [("a", "https://a/p/ok/1", True), ("a", "https://a/p/1?q=1", False), ("a", "https://a/a%20b/c", False), ("a", "https://a/a+b", True), ("a", "https://a", True), ("b", "https://b/", False), ("c", "https://c/x", True), ("d", "https://d/x", True), ("e", "https://e/x", True), ("f", "https://f/x", False), ("a", "https://a/%zz", True)]
    asked = spark.createDataFrame(urls, "host string, url string, want boolean")
    assert {(r.url, r.allowed) for r in crawl.robots_allowed(asked, more, "bot").collect()} == {(u, w) for _, u, w in urls}
    assert not {(r.url, r.allowed) for r in crawl.robots_allowed(asked.where("host = 'a'"), more, "none").collect()} & {(u, True) for h, u, _ in urls}
    found = spark.createDataFrame([("s", f"u{i}", AT if i else None) for i in range(5)] + [("t", "u", AT)], "source_id string, canonical_url string, first_at timestamp")
    assert {(r.canonical_url, r.page_no) for r in crawl.capped(found, 2).collect()} == {("u0", 1), ("u1", 2), ("u", 1)}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {(r.node, r.level) for r in crawl.frontier(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_frontier_has_no_last_level(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(54)], "src string, dst string")
    seeds = spark.createDataFrame([("n0",)], "node string")
    assert {(r.node, r.level) for r in crawl.frontier(edges, seeds).collect()} == {(f"n{i}", i) for i in range(55)}
    with pytest.raises(ValueError):
        crawl.frontier(edges, seeds, levels=2)


def test_prompt(spark):
    chunk = F.struct(*(F.lit(v).alias(k) for k, v in (("canonical_url", "u"), ("title", "t"), ("breadcrumb", "b"), ("text", T.END))))
    assert spark.range(1).select(T.user_prompt(F.lit("q"), F.array(chunk))).first()[0] == f"{T.BEGIN}\n--- Source 1 ---\nURL: u\nTitle: t\nBreadcrumb: b\n\n[END_DOC]\n{T.END}\n\nQuestion: q"

"""Problems 1, 2, 4, 6, 8 and 10 against brute force and round trips."""

import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import dom, main_content, markup, repetition, shared_lines, split, tokens
from siltstone.llm.words import TOKEN, WordHash

# --- 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n#`中。é_", min_size=0, max_size=400), st.integers(5, 40))
def test_pieces_are_the_text(text, limit):
    overlap = limit // 4
    cut = split.pieces(text, limit, overlap)
    if not text:
        assert cut == []
        return
    assert all(n <= limit and len(TOKEN.findall(t)) == n for n, _, _, t in cut)
    assert cut[0][1:3] == (0, 0) and all(b == overlap for _, b, _, _ in cut[1:]) and "".join(t[chars:] for _, _, chars, t in cut) == text
    for (_, _, _, before), (_, back, _, after) in zip(cut, cut[1:]):
        assert TOKEN.findall(before)[-back:] == TOKEN.findall(after)[:back]
    bodies = [t if not b else t[list(TOKEN.finditer(t))[b].start() :] for _, b, _, t in cut]
    assert "".join(x for i, b in enumerate(bodies) for x in TOKEN.findall(b)) == "".join(TOKEN.findall(text))


def test_cuts_lie_at_boundaries():
    text = "\n\n".join("This is sentence one. Here is another one, with a comma." * 1 for _ in range(80))
    for n, back, _, piece in split.pieces(text)[1:]:
        start = [m.start() for m in TOKEN.finditer(piece)][back]
        assert piece[:start].endswith("\n\n")
    assert [n for n, *_ in split.pieces("x" * 5000)] == [1]
    assert max(n for n, *_ in split.pieces("中" * 3000)) <= 400


def test_split_rows(spark):
    long = "word " * 900
    rows = [("a", long, "short"), ("a", long, "short"), ("b", None, long), ("c", "short", long), ("d", None, None), ("e", "", long), (None, long, None), (None, long + "x", None), ("f", "word " * 400, None)]
    df = spark.createDataFrame(rows, "chunk_id string, primary_text string, text string").withColumn("n_pieces", F.lit("x")).withColumn("whole", F.lit(1))
    got = split.split_oversized(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r.chunk_id].append(r)
    assert set(by) == {"a", "b", None} and len(by["a"]) == by["a"][0].n_pieces and len(by[None]) >= 2 * 3
    assert all(r.n_tokens <= 400 and r.overlap_tokens == (50 if r.piece_no else 0) for r in got)
    assert split.split_oversized(df.where("false")).count() == 0


# --- 2

NOTE = "Copyright 2020 the Site project, all rights."
TEXT = "source_id string, document_id string, extract_id bigint, extracted_text string"


def line_rows():
    out = [("s", f"d{i}", i, f"Own line number {'x' * i} of page\n  copyright  {1990 + i} THE site project, all rights.\r\n```\n{NOTE}\n```\nshort") for i in range(6)]
    out += [("t", f"t{i}", 100 + i, NOTE) for i in range(3)]  # too few documents
    out += [("u", f"u{i}", 200 + i, (NOTE if i < 4 else f"Nothing shared here at all {'y' * i}")) for i in range(100)]  # under the share
    out += [("s", "d0", 300, NOTE), ("s", None, 301, NOTE), (None, "n", 302, NOTE), ("s", "d9", 303, None), ("s", "d8", 304, ""), ("v", "v1", 400, NOTE), ("v", "v1", 401, NOTE), ("v", "v1", 402, NOTE), ("v", "v1", 403, NOTE)]
    return out


def test_repeated_lines(spark):
    df = spark.createDataFrame(line_rows(), TEXT).withColumn("line", F.lit("x")).withColumn("support", F.lit(0))
    assert {(r.extract_id, r.line_no) for r in shared_lines.repeated_lines(df).collect()} == {(i, 1) for i in range(6)} | {(300, 0), (301, 0)}
    clean = {r.extract_id: r for r in shared_lines.without_repeated_lines(df).collect()}
    assert len(clean) == df.count() and clean[300].extracted_text == "" and clean[303].extracted_text is None and clean[302].extracted_text == NOTE
    assert clean[2].extracted_text == f"Own line number xx of page\n```\n{NOTE}\n```\nshort"
    assert shared_lines.repeated_lines(df.where("false")).count() == 0


def test_frequent_sequences(spark):
    line = lambda c: f"shared line of the letter {c} in it"
    rows = [("s", f"d{i}", i, "\n".join(map(line, letters))) for i, letters in enumerate(["abc", "abc", "acb", "abxc", "bca", "z"])]
    found = shared_lines.frequent_sequences(spark.createDataFrame(rows, TEXT), closed=False, min_documents=3, min_share=0.0).collect()
    docs = [r[3].split("\n") for r in rows]
    held = lambda doc, seq: (it := iter(doc)) is not None and all(x in it for x in seq)
    want = defaultdict(int)
    import itertools

    for n in (1, 2, 3):
        for seq in itertools.product([line(c) for c in "abcxz"], repeat=n):
            s = sum(held(d, seq) for d in docs)
            if s >= 3:
                want[n, s] += 1
    got = defaultdict(int)
    for r in found:
        got[r.length, r.support] += 1
    assert got == want


def test_long_sequences(spark):
    rows = [("s", f"d{i}", i, "\n".join(f"line {c * 3} of the footer on every page" for c in "abcdefgh")) for i in range(4)]
    df = spark.createDataFrame(rows, TEXT)
    found = shared_lines.frequent_sequences(df, closed=False).collect()
    assert len(found) == 2**8 - 1 and max(r.length for r in found) == 8
    assert [(r.length, r.support) for r in shared_lines.frequent_sequences(df).collect()] == [(8, 4)]
    assert shared_lines.frequent_sequences(df.where("false")).count() == 0


def test_closed_sequences_hold_all_others(spark):
    """Every frequent sequence is part of a closed one with the same support, over texts with repeated lines, two rows of a document and several sources."""
    import random

    rng = random.Random(4)
    line = lambda c: f"shared line of the letter {c * 3} in it"
    rows = []
    for source in "st":
        for i in range(14):
            letters = [c for c in "cde" if rng.random() < 0.8]
            if rng.random() < 0.3:
                rng.shuffle(letters)
            letters = ["a", *letters[:2], "b", *letters[2:]] if rng.random() < 0.8 else [*letters, "b"]  # b stands after each a
            if rng.random() < 0.3:
                letters.append(rng.choice("bc"))
            rows.append((source, f"d{i % 12}", len(rows), "\n".join(map(line, letters))))
    df = spark.createDataFrame(rows, TEXT)
    every = shared_lines.frequent_sequences(df, closed=False, min_documents=3, min_share=0.0).collect()
    closed = shared_lines.frequent_sequences(df, min_documents=3, min_share=0.0).collect()
    inside = lambda s, t: (it := iter(t)) is not None and all(x in it for x in s)
    assert {(r.source_id, tuple(r.pattern), r.support) for r in closed} <= {(r.source_id, tuple(r.pattern), r.support) for r in every} and len(closed) < len(every)
    assert all(any(r.source_id == c.source_id and r.support == c.support and inside(r.pattern, c.pattern) for c in closed) for r in every)


# --- 4


KINDS = {
    "plain # not\n# Heading\n- item\n1. one\n> quote\na | b\n`<b>` 2 * 3 * 4, $5 and $6, C:\\dir\\file, R&D, #a < #b, [12], a_b_c __init": [],
    "```\n<b>x</b> **y** \\frac{a}{b}\n```": [],
    "<b>x</b>": ["html"], "a &nbsp; b": ["html"], "x <!-- y -->": ["html"], "<br/>": ["html"], "a <unknown> b": [],
    "**x**": ["markdown"], "*x y*": ["markdown"], "[a](/b)": ["markdown"], "![a](b.png)": ["markdown"], "- [x] done": ["markdown"], "| a |\n|---|\n| b |": ["markdown"], "[^1]": ["markdown"], "[a]: /b": ["markdown"], "~~x~~": ["markdown"], ":::note x\ny\n:::": ["markdown"],
    "'''x'''": ["wiki"], "[[A|b]]": ["wiki"], "{{cn|x}}": ["wiki"], "== A ==": ["wiki"], "{| class=x\n|-\n! a !! b\n|}": ["wiki"], "__TOC__": ["wiki"], "[https://a.example b]": ["wiki"],
    "$x^2$": ["latex"], "$$a+b$$": ["latex"], "\\section{A}": ["latex"], "\\[ x \\]": ["latex"], "\\begin{itemize}\n\\item a\n\\end{itemize}": ["latex"], "x \\cite{a}": ["latex"],
    "<i>a</i> **b** [[c]] $d_1$": ["html", "markdown", "wiki", "latex"],
}


@pytest.mark.parametrize("text", KINDS)
def test_kinds(text):
    kinds, clean = markup.clean(text)
    assert kinds == KINDS[text]
    if not kinds:
        assert clean == text


def test_clean_text():
    clean = lambda t: markup.clean(t)[1]
    assert clean("<h2>A &amp; B</h2><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><pre>code\n  in</pre><p>see <a href='/x'>this</a> <code>f</code></p>") == "## A & B\n\n- x\n\n- y\n\n1 | 2\n\n```\ncode\n  in\n```\n\nsee this `f`"
    assert clean("**bold** and [link](/x) and ~~old~~ `**kept**`") == "bold and link and old `**kept**`"
    assert clean("== Title ==\n'''b''' [[Page|text]] {{gone}}\n{| class=x\n! a !! b\n|-\n| 1 || 2\n|}") == "## Title\nb text\n\na | b\n\n1 | 2"
    assert clean("\\section{T}\n\\begin{itemize}\n\\item one\n\\end{itemize}\n\\textbf{b} $x^2$ as in~\\cite{k}") == "## T\n\n- one\n\nb $x^2$ as in"
    assert clean("a <b>x</b>\n```\n<i>\n```") == "a x\n```\n<i>\n```"


def test_rare_and_nested_markup():
    assert markup.clean("+ [ ] task") == (["markdown"], "+ task") and markup.clean("| a | b |  \nc")[0] == ["markdown"] and markup.clean("x\n| a | b | \t") == (["markdown"], "x\na | b")
    assert markup.clean("\\textbf{\\emph{\\texttt{\\textit{\\underline{x}}}}} y") == (["latex"], "x y")
    assert markup.clean("[[[[a](/1)](/2)](/3)](/4)")[1] == "a" and markup.clean("&amp;amp;lt;b&amp;amp;gt;x")[1] == "x"


def test_markup_of_every_kind_is_in_the_tree():
    root = markup.tree("<p>a **b** [c](/d)</p> [[E|ee]] $x^2$ &amp; </i>")
    assert markup.kinds_of(root) == ["html", "markdown", "wiki", "latex"]
    markup.measure(root)
    assert root.tags == 8 and root.link_tags == 2 and root.link_chars == 3  # the body, p, two, a link, a formula, an entity and a tag that closes nothing
    assert markup.kinds_of(markup.tree("plain")) == []


def test_groups_of_marked_links_are_left_out():
    """Links count whatever their markup is."""
    content = "<div>" + "".join(f"<p>{'A sentence with many words stands here, and it goes on. ' * 8}</p>" for _ in range(3)) + "</div>"
    for links in ("[Home](/a) [Guides](/b) [Help](/c)", "[[Home]] [[Guides]] [[Help]]"):
        assert "Guides" not in markup.clean(f"<div>{links}</div>{content}")[1]
    assert "Guides" in markup.clean(f"<div>Guides tell how to do it, step by step. [Home](/a)</div>{content}")[1]


def test_deep_and_wide_trees():
    assert markup.clean("<div>" * 20000 + "deep")[1] == "deep"
    assert markup.clean("<b>" * 3000 + "x" + "</b>" * 3000 + " y") == (["html"], "x y")
    assert markup.clean("\\textbf{" * 200 + "x" + "}" * 200)[1] == "x"
    assert markup.clean("<ul>" + "<li>a</li>" * 5000 + "</ul>")[1].count("- a") == 5000


def test_the_selected_subtree_stays_whole():
    items = "".join(f"<li><a href='/{i}'>Entry number {i}, which is described there, at length</a></li>" for i in range(9))
    text = f"<div><p>Short.</p></div><div><ul>{items}</ul></div><div><a href='/h'>Home</a> <a href='/d'>Docs</a></div>"
    root = markup.tree(text)
    markup.measure(root)
    inside, least = markup.select(root)
    best = max((x for x in walk(root)), key=lambda e: e.total)
    assert id(best) in inside and {id(x) for x in walk(best)} == inside and least <= best.density


def walk(root):
    todo = [root]
    while todo:
        e = todo.pop()
        yield e
        todo += [p for p in e.parts if isinstance(p, markup.Element)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ab*_[]()|={}'\\$`~&;!-:^ \n\x00", max_size=80))
def test_clean_never_fails(text):
    markup.clean(text)


def test_markup_rows(spark):
    df = spark.createDataFrame([("t", "1", "<b>x</b>"), ("t", "2", "plain"), ("t", "2", "plain"), ("t", None, "**y**")], "record_table string, record_id string, text string").withColumn("kinds", F.lit(1))
    assert sorted((r.record_id or "", r.kinds, r.clean_text) for r in markup.clean_markup(df).collect()) == [("", ["markdown"], "y"), ("1", ["html"], "x"), ("2", [], "plain"), ("2", [], "plain")]
    assert markup.clean_markup(df.where("false")).count() == 0


# --- 6

PAGE = """﻿<!doctype html><html><head><title>T</title></head><body><nav><ul><li><a href=/a>Home</a></li><li>Docs</li></ul></nav>
<main><h1>Working with caches</h2><p>A cache holds <code>n</code> entries, and the <b>oldest</b> one leaves.</p><div class="feedback"><div>Was this page helpful?</div><div>Yes</div></div>
<pre>x = 1

y = 2</pre><ul><li>First entry of the list</li><li>Second</li></ul><aside class="hint">Hold the lock while the entry moves.</aside></main><script>var a = "<p>no</p>";</script>
<footer><div>Copyright 2020</div>&nbsp;<div>Imprint</div></footer></body>"""


def test_page_units():
    page = dom.Page(dom.decode(PAGE.encode()))
    assert [t.strip()[:20] for t in page.texts] == ["Home", "Docs", "Working with caches", "A cache holds n entr", "Was this page helpfu", "Yes", "x = 1\n\ny = 2", "First entry of the l", "Second", "Hold the lock while ", "Copyright 2020", "Imprint"]
    own = [False, False, True, True, False, False, True, True, True, True, False, False]
    assert main_content.own_units(page, frozenset([4])) == own  # the question and its answers are a group with few points
    notice = dom.Page("<main><p>A cache holds entries, and the oldest leaves.</p><div>We use cookies, for more.</div><p>Read on, in peace, here.</p></main>")
    assert main_content.own_units(notice) == [True, True, True] and main_content.own_units(notice, frozenset([1])) == [True, False, True]


def test_text_blocks():
    text = "Home / Guides / Caches\n\n# Caches\n\nA cache holds entries, and the oldest leaves.\n\n- Contents\n- Caches\n\n```\nHome\n\nDocs\n```\n\nget_entry | old cache | 3 rows\nput_entry | new cache | 4 rows\n\nWritten by the Acme crew on 2020-01-01\nMore of the page stands here, in a sentence.\n\nPrivacy | Terms | Imprint\n\n[Prev: A](/a) | [Next: B](/b)\n\nGet Acme now"
    assert main_content.own_blocks(text) == [False, True, True, False, True, True, True, False, False, False]


def test_texts_are_scored_as_trees():
    content = "The cache of Acme holds entries, keeps them in order, and drops the oldest one when there is no room left for another."
    notice = "This material is provided as is, and Acme gives no warranty."
    text = f"# Caches\n\n{content}\n\n{notice}"
    assert main_content.own_blocks(text) == [True, True, True] and main_content.own_blocks(text, frozenset([4])) == [True, True, False]
    # a section with far fewer points than the best one keeps what is no link
    long = "A cache holds entries, keeps them in order, and drops the oldest one when there is no room left for another. " * 6
    links = "See also [the page on sizes](/a), [the index](/b), for more."
    assert main_content.own_blocks(f"{links}\n\n# Caches\n\n{long}\n\n## More\n\nThe last entry leaves first.") == [False, True, True, True, True]
    # the same block stays where it stands in the container
    assert main_content.own_blocks(links) == [True]


TEXTS = "extract_id bigint, source_id string, extracted_text string"


@pytest.mark.parametrize("most_shared", [100, 0])
def test_repeated_lines_have_no_points(spark, most_shared):
    """A notice that reads like a sentence is known by its repetition within its source; copies of a page are one page. Both ways of sending the repeated lines."""
    own = [f"# Page\n\nThe {w} cache holds entries, keeps them in order, and drops the oldest.\n\nWe keep cookies, as you may know, since {i}." for i, w in enumerate("red green blue grey pink white black brown".split())]
    rows = [(i, "s", x) for i, x in enumerate(own)] + [(100 + i, "s", own[0]) for i in range(30)]  # most rows are copies of one page
    rows += [(200, "t", own[0]), (201, None, own[0])] + [(300 + i, "u", own[0]) for i in range(9)] + [(400, "s", None), (401, "s", "")]
    df = spark.createDataFrame(rows, TEXTS).withColumn("shared", F.lit(1)).withColumn("page", F.lit("x"))
    got = {}
    for r in main_content.text_units(df, most_shared=most_shared).collect():
        got.setdefault(r.record_id, {})[r.unit_no] = r.own
    assert all(got[i] == {0: True, 1: True, 2: False} for i in (*range(8), *range(100, 130)))
    assert all(got[i] == {0: True, 1: True, 2: True} for i in (200, 201, *range(300, 309))) and 400 not in got
    kept = {r.record_id: r.content for r in main_content.own_text(df, "text", most_shared=most_shared).collect()}
    assert kept[3] == "\n\n".join(own[3].split("\n\n")[:2]) and kept[200] == own[0] and kept[400] is None and kept[401] == ""


def test_unit_rows(spark):
    texts = spark.createDataFrame([(1, "s", "# A\n\nHome | Docs"), (2, "s", None), (3, "s", ""), (4, None, "x" * 100000)], TEXTS).withColumn("own", F.lit(1))
    assert sorted((r.record_id, r.unit_no, r.own) for r in main_content.text_units(texts).collect() if r.record_id < 4) == [(1, 0, True), (1, 1, False)]
    pages = spark.createDataFrame([(1, "s", bytearray(PAGE.encode())), (2, "s", None), (3, "s", bytearray(b"")), (4, "s", bytearray(b"\xff<<p")), (5, None, bytearray(b"<div><a href=x>Home</a></div>"))], "fetch_id bigint, source_id string, body binary")
    got = main_content.page_units(pages).collect()
    assert sum(r.record_id == 1 for r in got) == 12 and [r.own for r in got if r.record_id == 5] == [False]
    assert main_content.text_units(texts.where("false")).count() == 0
    kept = {r.record_id: r.content for r in main_content.own_text(pages, "page").collect()}
    assert kept[1].startswith("Working with caches\nA cache holds n entries") and kept[2] is None and kept[3] == ""
    deep = spark.createDataFrame([(1, "s", bytearray(b"<div>" * 5000 + b"<p>A sentence stands here, deep down.</p>"))], "fetch_id bigint, source_id string, body binary")
    assert [r.own for r in main_content.page_units(deep).collect()] == [True]


# --- 8

try:
    VOCABULARY = open(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}", "rb").read()
except OSError:
    VOCABULARY = b""
needs_vocabulary = pytest.mark.skipif(not VOCABULARY, reason="no public tokenizers here")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    known = Tokenizer.from_str(VOCABULARY.decode())
    known.encode_special_tokens = True
    return lambda texts: [e.ids for e in known.encode_batch(texts, add_special_tokens=False)]


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80) | st.text(alphabet="aeinrst TH'  \n1_-=", max_size=200))
def test_encoding(reference, text):
    assert tokens.encoder(VOCABULARY).encode([text]) == reference([text])


@needs_vocabulary
def test_encoded_rows(spark, reference):
    texts = [None, "", "<|endoftext|>", "a" * 3000, " " * 500, "中文テスト" * 200, "Hello, world"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(6, texts[6])], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect())
    assert got == sorted(zip([*range(7), 6], reference([t or "" for t in [*texts, texts[6]]])))
    assert tokens.encode_corpus(df.where("false")).count() == 0


# --- 10


def share(text, n=5):
    words = re.findall(r"[々〇぀-ヿ㐀-鿿]|[^\W_々〇぀-ヿ㐀-鿿]+", re.sub(r"\d+", "0", text.lower()))
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    return 1 - len(set(grams)) / len(grams) if grams else 0.0


def test_repeated_share(spark):
    texts = ["a b c d e " * 4, "one two three four five six seven", "x1 y2_z3 W4 v5 " * 3, "中文" * 20, "", None, "a b", "line 12 of the log\n" * 9 + "other words stand at the end of it"]
    df = spark.createDataFrame([(i, "EN" if i % 2 else None, t) for i, t in enumerate(texts)] + [(0, "en", texts[0])], "doc_id bigint, lang string, text string").withColumn("n_words", F.lit("x"))
    got = repetition.repeated_share(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.repeated_share == pytest.approx(share(texts[r.doc_id] or ""))
    assert repetition.repeated_share(df.where("false")).count() == 0


def test_perplexity(spark):
    """Probabilities that follow a context add up to one, and documents that repeat themselves are less perplexing."""
    import random

    rng = random.Random(1)
    words = [f"w{chr(97 + i)}" for i in range(26)]
    docs = [(i, "en", " ".join(rng.choice(words) for _ in range(60))) for i in range(60)] + [(60, "EN ", "wa wb wc wd we " * 12), (61, "en", None), (62, None, ""), (63, "de", "eins zwei drei")]
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string")
    got = {r.doc_id: r for r in repetition.perplexities(df).collect()}
    assert len(got) == len(docs) and got[60].lang == "en" and got[61].perplexity is None and got[62].n_words == 0
    assert got[60].perplexity < min(got[i].perplexity for i in range(60)) and got[60].rejected
    rows = df.select("text", F.hash(repetition.language()).alias("lang"))
    lang = next(r.lang for r in rows.collect() if r.text and r.text.startswith("wa wb"))
    known = WordHash()
    vocabulary = [repetition.opened(w, lang, known)[2] for w in words]
    for cut, kept in ((0.0, len({h for _, x, t in docs if x and x.lower().strip() == "en" and t for h in zip(["", "", *t.split()], ["", *t.split()], t.split())}) + 3), (2e-3, None)):
        model = repetition.train(rows, cut)
        assert len(model.three[0].keys) == kept if kept else 0 < len(model.three[0].keys) <= 1 / cut
        for context in ([1, 1], "wa wb", "wx wq", "never seen"):
            u, v = [np.uint64(x) ^ np.uint64(lang & 0xFFFFFFFF) for x in context] if isinstance(context, list) else repetition.opened(context, lang, known)[2:4]
            ps = [float(np.exp(model.log_probabilities([np.array([u, v, w], np.uint64)], lang))[0]) for w in [*vocabulary, np.uint64(12345)]]
            assert min(ps) > 0 and sum(ps) == pytest.approx(1)
    assert repetition.perplexities(df.where("false")).count() == 0


def kneser_ney(docs):
    """The nats of each document under its language's modified Kneser-Ney model, in plain Python."""
    from collections import Counter
    from math import log

    grams = {i: list(zip(["^", "^", *t.split()], ["^", *t.split()], t.split())) for i, t in docs.items()}
    three = Counter(g for found in grams.values() for g in found)
    two = Counter(g[1:] for g in three)
    one = Counter(g[1] for g in two)

    def interpolated(counts, lower):
        n = [sum(c == i for c in counts.values()) for i in range(5)]
        d = [0.0, *(min(float(i), max(0.0, i - (i + 1) * n[1] / max(n[1] + 2 * n[2], 1) * n[i + 1] / n[i])) if n[i] and n[1] else 0.5 * i for i in (1, 2, 3))]
        whole, left = Counter(), Counter()
        for g, c in counts.items():
            whole[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        return {g: (max(c - d[min(c, 3)], 0.0) + left[g[:-1]] * lower(g)) / whole[g[:-1]] for g, c in counts.items()}

    p1 = {w: (c + 1 / (len(one) + 1)) / (len(two) + 1) for w, c in one.items()}
    p2 = interpolated(two, lambda g: p1[g[1]])
    p3 = interpolated(three, lambda g: p2[g[1:]])
    return {i: -sum(log(p3[g]) for g in found) / len(found) for i, found in grams.items()}


def test_perplexity_of_rare_sequences(spark):
    """No sequence is left out of a corpus too large for the model to be held: documents have the perplexities and bands of the whole model, whether every executor holds the model or it lies in parts."""
    import math
    import random

    rng = random.Random(2)
    words = {lang: [f"{lang}{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)] for lang in ("en", "de")}
    docs = {i: (lang, " ".join(rng.choices(words[lang], [1 / (k + 1) for k in range(144)], k=rng.randrange(1, 80)))) for i in range(120) for lang in ["de" if i % 3 == 0 else "en"]}
    rows = [(i, lang, text) for i, (lang, text) in docs.items()] + [(120, "en", None), (121, "de", " "), (122, None, ""), (None, "fr", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(3)
    want = {i: x for lang in words for i, x in kneser_ney({i: text for i, (name, text) in docs.items() if name == lang}).items()}
    edges = {}
    for lang in words:
        nats = sorted(x for i, x in want.items() if docs[i][0] == lang)
        edges[lang] = [nats[max(1, len(nats) - math.floor(len(nats) - len(nats) * q)) - 1] for q in (0.02, 0.98)]
    for cut in (repetition.CUT, 2e-3):
        got = repetition.perplexities(df, cut=cut).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id in want:
                lo, hi = edges[r.lang]
                assert math.log(r.perplexity) == pytest.approx(want[r.doc_id], rel=1e-9) and r.n_words == len(docs[r.doc_id][1].split())
                assert (math.log(r.low), math.log(r.high)) == pytest.approx((lo, hi), rel=1e-9) and r.rejected == (want[r.doc_id] < lo or want[r.doc_id] > hi)
            else:
                assert r.perplexity is None and r.n_words == 0 and not r.rejected

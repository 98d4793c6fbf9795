"""Problem 6: keep the page's own content, tell menus, notices, prompts, bylines, adverts, outlines and footers from it.

Method: tree scoring. Paragraphs get points for length and commas and pass them to their parent and, by half, to their
grandparent; an element's points are discounted by its link density. The element with the most points is the container of the content; its siblings
are kept if their own points reach a share of the best, and groups inside it that have no points are dropped.

An HTML page is the tree of its elements. A text is a tree of page, sections (each starts with a heading), blocks and lines. A block's points go to its
section and by half to the page, and so do its characters and those of its lines that look like links. Blocks of the container, and of its siblings with enough
points, stay if they have points; in other sections one of its lines must have points and little in links.

No list of phrases or names takes part. What reads like a sentence and yet is no content shows by its repetition: a line, or a piece of a page, that stands in at least
`MIN_DOCUMENTS` and `MIN_SHARE` of the pages of its source has no points (headings and code are not counted). Pieces are counted over all rows; rows with the same
longest piece are one page, so copies of a page do not make its content boilerplate.
Up to `MOST_SHARED` of them go to all executors as 8-byte hashes (32 MB); beyond it the rows get the numbers of their repeated pieces by a join.

Defined results: null bodies and texts have no units; a page without any paragraph has no container, and all its units are
boilerplate; rows that occur twice come out twice under their own ids; rows without a source have no repeated pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.dom import BLOCKS, HEADINGS, Node, Page, decode
from siltstone.llm.shared_lines import MIN_DOCUMENTS, MIN_SHARE, line_form
from siltstone.llm.words import fenced
from siltstone.session import bound_batches, spread, stage

#: Ends of sentences, and what may stand after them.
ENDS, CLOSERS = frozenset(".!?:。！？…"), "\"'”’)]}`*_ "
LINK = re.compile(r"!?\[[^\]\[\n]*\]\([^()\n]*\)")
#: What only a page's own text holds: code, data, markup, log lines.
OWN = re.compile(r"`|\\[a-zA-Z]+|\$\$|\{\||\|\}|^\|-|!!|\|\||\[\[|\]\]|\{\{|'''|__\w+__|\*\*|~~|^\s*[-*+] \[[ xX]\] |\[\^|^\[[^\]]+\]: |^:::|^\s*[\[{\"].*[\]},:\d]\s*$|</?[a-zA-Z]|&[a-z]+;|&#\d+;|^\s*>|^\d{4}-\d\d-\d\d[ T]\d\d:\d\d|==|!\[|:-{2,}|-{3,}")
ROW = re.compile(r"^\|?[^|]+(?:\|[^|]+)*\|\s*\d[\d.,]* [^\W\d]+\s*\|?$")
CODE_NAME = re.compile(r"^[a-z]+(?:[._][a-z]\w*|[A-Z]\w*)+(?:\(\))?$")
WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
HEADING, MOST_SHARED = 1.0, 1 << 22
#: Characters under which a sentence gets no points, as is usual for this method.
SHORTEST = 25
SIBLING_SHARE, LINK_SHARE, KEPT = 0.2, 0.25, frozenset("p pre h1 h2 h3 h4 h5 h6 ul ol dl table blockquote figure".split())
UNITS = "record_id bigint, unit_no int, own boolean"


def points(text: str) -> float:
    """Points of a line or paragraph for length and commas, 0 for what looks like a link or a label."""
    text = " ".join(text.split())
    bare = LINK.sub("", text) if "](" in text else text
    if bare != text and sum(c.isalnum() for c in bare) < 0.3 * sum(c.isalnum() for c in text) and not text.startswith("!"):
        return 0.0
    words = text.count(" ") + 1
    wide = len(WIDE.findall(text)) if not text.isascii() else 0
    if ((words >= 4 and len(text) >= SHORTEST) or wide >= 8) and text.rstrip(CLOSERS)[-1:] in ENDS:
        return 1.0 + text.count(",") + text.count("、") + min(len(text) / 100, 3)
    if OWN.search(text) or (ROW.match(text) and CODE_NAME.match(text.strip("| ").split("|")[0].strip())):
        return 1.0 + min(len(text) / 100, 3)
    if "|" in text or "·" in text or " / " in text or "›" in text or " > " in text:
        return 0.0
    if (words >= 9 and sum(w[0].isupper() for w in text.split()) < 0.4 * words) or wide >= 25:
        return 1.0 + min(len(text) / 100, 3)
    return 0.0


def blocks(text: str) -> list[list[tuple[int, str, bool]]]:
    """The blocks of a text: runs of lines that are not blank, (number, line, inside a fence); blank lines in a fence end none."""
    out: list[list[tuple[int, str, bool]]] = []
    fresh = True
    for n, line, inside in fenced(text.split("\n")):
        if not inside and not line.strip():
            fresh = True
            continue
        if fresh:
            out.append([])
            fresh = False
        out[-1].append((n, line, inside))
    return out


def own_blocks(text: str, shared: frozenset[int] = frozenset()) -> list[bool]:
    """Whether each block of a text holds a line of the page's own content; shared are the numbers of the lines that its source repeats."""
    root = Node("body", "", None)
    section = Node("section", "", root)
    nodes = []
    for block in blocks(text):
        heads = [not inside and line.lstrip().startswith("#") for _, line, inside in block]
        if any(heads):
            section = Node("section", "", root)
        node = Node("p", "", section)
        nodes.append(node)
        for (n, line, inside), head in zip(block, heads):
            chars = len(line.strip())
            reads = 0.0 if head or inside else points(line)
            worth = HEADING if head else 1.0 + min(chars / 100, 3) if inside else 0.0 if n in shared else reads
            node.chars += chars
            node.score += worth
            links = 0 if inside else sum(x.index("](") for x in LINK.findall(line)) if worth > 0 or reads > 0 else chars
            node.linked += links
            node.tags += worth > 0 and links < LINK_SHARE * chars  # lines that hold by themselves
        if not node.score and len(block) > 1 and not any(n in shared for n, _, _ in block):
            lines = [line for _, line, _ in block]
            cells = {line.count("|") for line in lines}
            if len(cells) == 1 and cells.pop() > 1 and all(CODE_NAME.match(line.split("|")[0].strip()) for line in lines):  # rows without a sentence
                node.score, node.linked, node.tags = 1.0 + min(node.chars / 100, 3), 0, 1
        for up, share in ((section, 1.0), (root, 0.5)):
            up.score += share * node.score
            up.chars += node.chars
            up.linked += node.linked
    total = lambda x: x.score * (1 - x.linked / max(1, x.chars))
    best = max([root, *root.children], key=total)
    least = 0.0 if best is root else SIBLING_SHARE * total(best)
    return [x.score > 0 and (total(x.parent) >= least or x.parent is best or x.tags > 0) for x in nodes]


def own_units(page: Page, shared: frozenset[int] = frozenset()) -> list[bool]:
    """Whether each unit of a page is its own content; shared are the numbers of the units that its source repeats."""
    n = len(page.texts)
    worth = [0.0] * n
    for u, text in enumerate(page.texts):
        chars = len(text.strip())
        node = page.at[u]
        worth[u] = (1.0 + min(chars / 100, 3)) if node.tag == "pre" else 0.0 if u in shared else points(text) * (1 - min(1.0, page.linked[u] / max(1, chars)))
    order = list(page.root.walk())
    for node in reversed(order):
        node.chars += sum(len(page.texts[u].strip()) for u in node.units)
        node.linked += sum(page.linked[u] for u in node.units)
        node.tags += len(node.units)
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.tags += node.tags
        for u in node.units:
            if worth[u] > 0:
                up = node.parent or node
                if node.tag in ("li", "td", "th", "tr", "dd", "dt"):
                    while up.parent is not None and up.tag in ("ul", "ol", "dl", "table", "tbody", "tr", "thead"):
                        up = up.parent
                    if node.tag in ("td", "th") and len(node.children) > 0:
                        up = node
                up.score += worth[u]
                if up.parent is not None:
                    up.parent.score += worth[u] / 2
    best = max(order, key=lambda x: x.score * (1 - x.linked / max(1, x.chars)))
    own = [False] * n
    if best.score <= 0:
        return own

    def settle(node: Node) -> None:
        """Mark the units of a container's part."""
        units = [u for x in node.walk() for u in x.units]
        if not units:
            return
        chars = sum(len(page.texts[u].strip()) for u in units)
        linked = sum(page.linked[u] for u in units)
        if node.tag in KEPT:
            if linked > 0.5 * chars and node.tag in ("ul", "ol", "p", "dl", "table") and not any(points(page.texts[u]) > 0 for u in units):
                return  # links, and none of them reads like a sentence
            if node.tag not in HEADINGS and all(u in shared for u in units):
                return
        elif not any(x.tag in BLOCKS or x.tag == "button" for x in node.walk() if x is not node):
            if linked > 0.5 * chars or all(u in shared for u in units):
                return
        elif sum(len(page.texts[u].strip()) for u in units if worth[u] > 0) <= 0.5 * chars:
            return
        for u in units:
            own[u] = True

    parts = [best]
    if best.parent is not None:
        top = best.score * (1 - best.linked / max(1, best.chars))
        parts += [x for x in best.parent.children if x is not best and x.score * (1 - x.linked / max(1, x.chars)) >= SIBLING_SHARE * top]
    for part in parts:
        for u in part.units:
            own[u] = worth[u] > 0 or u not in shared
        for child in part.children:
            settle(child)
    return own


def text_pieces(text: str) -> list[tuple[int, str]]:
    """(number, line) of the lines that repetition is counted for: no headings, nothing in fences."""
    return [(n, line) for n, line, inside in fenced(text.split("\n")) if not inside and line.strip() and not line.lstrip().startswith("#")]


def page_pieces(page: Page) -> list[tuple[int, str]]:
    """(number, text) of the units that repetition is counted for: no headings, no code blocks."""
    return [(u, t) for u, t in enumerate(page.texts) if page.at[u].tag not in HEADINGS and page.at[u].tag != "pre"]


def piece_keys(pieces: list[tuple[int, str]], source: str) -> np.ndarray:
    """Hashes of pieces within their source; pieces that differ in case, blanks and digits only have one."""
    seed = xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass"))
    return np.array([xxhash.xxh3_64_intdigest(line_form(x).encode("utf-8", "surrogatepass"), seed) for _, x in pieces], np.uint64).view(np.int64)


def occurrences(df: DataFrame, opened: Callable, pieces: Callable) -> DataFrame:
    """(record_id, no, source, key, page): each piece of each row of df(record_id, content, source_id); page is the hash of the row's longest piece.

    Copies of a page, its older versions and most of its near copies have the same longest piece, and so count as one page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nos, keys, pages = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (x, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = pieces(opened(x))
                if not found:
                    continue
                own = piece_keys(found, source)
                at.append(np.full(len(found), i))
                nos.append(np.array([n for n, _ in found], np.int32))
                keys.append(own)
                pages.append(np.full(len(found), own[max(range(len(found)), key=lambda k: len(found[k][1]))]))
            rows = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.concatenate(nos)), batch.column(3).take(rows), pa.array(np.concatenate(keys)), pa.array(np.concatenate(pages))], names=["record_id", "no", "source", "key", "page"])

    rows = df.where("source_id is not null").select("record_id", "content", "source_id", F.xxhash64("source_id").alias("source"))
    return spread(rows).mapInArrow(run, "record_id bigint, no int, source bigint, key bigint, page bigint")


def shared_keys(found: DataFrame, min_pages: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(key) of the pieces that enough pages of their source hold; a piece, a source or a page with most rows is added up before the shuffle."""
    once = found.select("source", "key", "page").distinct()
    support = once.groupBy("source", "key").agg(F.count("*").alias("support"), F.count_if(F.col("key") == F.col("page")).alias("longest"))
    pages = support.groupBy("source").agg(F.sum("longest").alias("pages"))  # each page has one longest piece
    return support.where(F.col("support") >= min_pages).join(pages, "source").where(F.col("support") >= F.lit(min_share) * F.col("pages")).select("key")


def _judged(df: DataFrame, kind: str, emit: Callable, schema: str, most_shared: int) -> DataFrame:
    """emit(record ids, opened contents, own units) of the rows of df, `kind` 'text' or 'page', as rows of `schema`."""
    bound_batches(df.sparkSession)
    if kind == "text":
        rows = df.select(F.col("extract_id").alias("record_id"), F.col("extracted_text").alias("content"), "source_id")
        opened, pieces, judge = (lambda x: x or ""), text_pieces, own_blocks
    else:
        rows = df.select(F.col("fetch_id").alias("record_id"), F.col("body").alias("content"), "source_id")
        opened, pieces, judge = (lambda x: Page(decode(x))), page_pieces, own_units
    full = rows.where(F.length("content") > 0)
    keys = stage(shared_keys(occurrences(full, opened, pieces)), "shared")
    few = keys.count() <= most_shared
    known = np.sort(np.asarray(keys.toArrow().column(0).to_numpy(), np.int64)) if few else None
    if few:
        rows = rows.withColumn("shared", F.lit(None).cast("array<int>"))
    else:
        repeated = occurrences(full, opened, pieces).join(keys, "key", "left_semi").groupBy("record_id").agg(F.collect_set("no").alias("shared"))
        rows = rows.join(repeated, "record_id", "left")
    sent = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids, contents, owns = [], [], []
            for i, x, source, shared in zip(*(batch.column(c).to_pylist() for c in range(4))):
                whole = opened(x)
                if known is not None and len(known) and source is not None and x:
                    found = pieces(whole)
                    keys = piece_keys(found, source)
                    hit = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
                    shared = [n for (n, _), h in zip(found, hit) if h]
                ids.append(i)
                contents.append((x, whole))
                owns.append(judge(whole, frozenset(shared or ())) if x else [])
            yield emit(ids, contents, owns)

    return spread(rows.select("record_id", "content", "source_id", "shared")).mapInArrow(run, schema)


def _units(ids: list, contents: list, owns: list) -> pa.RecordBatch:
    at = np.repeat(np.arange(len(ids)), [len(o) for o in owns])
    flat = np.array([x for o in owns for x in o], bool)
    numbers = np.array([n for o in owns for n in range(len(o))], np.int32)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(at)), pa.array(numbers), pa.array(flat)], names=["record_id", "unit_no", "own"])


def text_units(df: DataFrame, most_shared: int = MOST_SHARED) -> DataFrame:
    """(record_id, unit_no, own) of each block of df(extract_id, source_id, extracted_text)."""
    return _judged(df, "text", _units, UNITS, most_shared)


def page_units(df: DataFrame, most_shared: int = MOST_SHARED) -> DataFrame:
    """(record_id, unit_no, own) of each unit of df(fetch_id, source_id, body)."""
    return _judged(df, "page", _units, UNITS, most_shared)


def own_text(df: DataFrame, kind: str, most_shared: int = MOST_SHARED) -> DataFrame:
    """(record_id, content) of each row: its own units in order; kind as for text_units and page_units. Null stays null, and what is empty empty."""

    def joined(x, whole, own: list[bool]) -> str | None:  # noqa: ANN001
        if not x:
            return None if x is None else ""
        if kind == "text":
            return "\n\n".join("\n".join(line for _, line, _ in b) for b, o in zip(blocks(whole), own) if o)
        return "\n".join(t.strip() for t, o in zip(whole.texts, own) if o)

    def emit(ids: list, contents: list, owns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([joined(x, whole, own) for (x, whole), own in zip(contents, owns)], pa.string())], names=["record_id", "content"])

    return _judged(df, kind, emit, "record_id bigint, content string", most_shared)

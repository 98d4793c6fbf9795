"""Problem 4: turn texts with HTML, Markdown, wiki or LaTeX markup into clean text that keeps headings, lists, tables, code and formulas.

Method: composite text density. A text becomes a tree: HTML elements nest, and every other piece of markup is a leaf that counts as a tag; links
count as link tags with link characters. Each node has the density (characters / tags), lowered by the share of links, of its subtree; the densities of
its children are added up. The subtree with the largest sum is selected and stays whole; the smallest density on the path from it up to the body is the threshold, and
outside the selected subtree HTML elements below it that consist of links are left out. The kinds of a text are the kinds of the tags counted in its tree.

What counts is outside fences and inline code. The form that the tables' own texts have is no markup: `#` headings, plain items, `>` quotes, rows
`a | b` without a rule, fences and inline code. Formulas count as LaTeX and stay as they are.

Defined results: null and empty texts have no row; a text without markup comes back unchanged with no kinds; a fence that is never closed
reaches to the end. Rows with the same key come out one by one.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.words import fenced
from siltstone.session import bound_batches, spread

KINDS = ("html", "markdown", "wiki", "latex")
#: Names of HTML elements (fixed values).
ELEMENTS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn dialog div dl dt em embed "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark menu meta "
    "nav noscript object ol optgroup option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg "
    "table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
)
CODE = re.compile(r"(?<!`)(`+)(?!`)([^\n]*?[^`\n])\1(?!`)")
HTML = re.compile(rf"<!--.*?(?:-->|\Z)|<!doctype\b[^<>]*>|<(/?)({'|'.join(ELEMENTS.split())})(\s[^<>]*|/)?>|&(?:[A-Za-z][A-Za-z0-9]{{1,31}}|#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}});", re.I | re.S)
MARKDOWN = re.compile(
    r"""!\[(?P<alt>[^\]\[\n]*)\]\([^()\n]*\)|\[(?P<text>[^\]\[\n]*)\]\([^()\s]*(?:\s+"[^"\n]*")?\)|\[(?P<ref>[^\]\[^\n][^\]\[\n]*)\]\[[^\]\[\n]*\]"""
    r"""|^[ ]{0,3}\[\^[^\]\s]+\]:[ ]?|^[ ]{0,3}(?P<definition>\[[^\]\n]+\]:[ \t]*\S+)[^\n]*|\[\^[^\]\s]+\]"""
    r"""|^(?P<task>[ \t]*[-*+][ ])\[[ xX]\][ \t]|(?<![\w*\\])\*\*(?=[^\s*])(?P<bold>[^*\n]*?[^\s*])\*\*(?![\w*])|(?<![\w*\\])\*(?=[^\s*])(?P<emph>[^*\n]*?[^\s*])\*(?![\w*])"""
    r"""|~~(?=\S)(?P<gone>[^~\n]*\S)~~|(?<![\w\\])__(?!(?:NO)?[A-Z]+__)(?=[^\s_])(?P<strong>[^_\n]*[^\s_])__(?!\w)"""
    r"""|^[ ]{0,3}(?P<rule>\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+(?:[ \t]*:?-{2,}:?[ \t]*)?)$|^[ ]{0,3}:::[ \t]*(?P<note>[^\n]*)$|^\|[ \t]*(?P<row>[^|\n][^\n]*?)[ \t]*\|[ \t\r]*$""",
    re.M,
)
WIKI = re.compile(
    r"""'{2,5}(?=[^\s'])(?P<quoted>[^'\n]*[^\s'])'{2,5}|\[\[(?:File|Image|Category):[^\[\]\n]*\]\]|\[\[(?:[^\[\]|\n]*\|)?(?P<link>[^\[\]|\n]+)\]\]|\{\{[^{}\n]+\}\}"""
    r"""|^(?P<level>={2,6})[ \t]*(?P<heading>[^=\n][^\n]*?)[ \t]*(?P=level)[ \t\r]*$|^\{\|[^\n]*$|^\|\}[^\n]*$|^\|-[ \t\r]*$|^!(?P<head>[^\n]*?!![^\n]*)$|^\|(?P<cells>[^\n|]*\|\|[^\n]*)$"""
    r"""|\[https?://\S+ (?P<named>[^\]\n]+)\]|__(?:NO)?TOC__|</?(?:ref|nowiki|gallery)\b[^<>]*>""",
    re.M,
)
LATEX = re.compile(
    r"""(?P<formula>\$\$[^$]+\$\$|\\\[.+?\\\]|\\\(.+?\\\)|(?<![\\$\w])\$(?=[^\s$])(?!\d+(?:[.,]\d+)*[ ,.;])[^$\n]*[\\^_{}=+<>*/|()][^$\n]*?(?<=[^\s$\\])\$(?![\d\w]))"""
    r"""|\\(?P<level>(?:sub){0,2}section|chapter|paragraph)\*?\{(?P<title>[^{}\n]*)\}|\\(?:begin|end)\{[A-Za-z*]+\}(?:\[[^\]\n]*\])?|^(?P<indent>[ \t]*)\\item\b[ \t]*(?:\[[^\]\n]*\])?"""
    r"""|~?\\(?:cite|ref|label|eqref|pageref|autoref)[a-z]*\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}|\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{(?P<body>[^{}\n]*)\}|\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{|\$\$|\\[\[\]()]"""
    r"""|\\(?:frac|sum|int|alpha|beta|lambda|leq|geq|cdot|log|maketitle|par|noindent|hline|centering)\b""",
    re.M | re.S,
)
#: A command whose argument holds others.
OPENED = re.compile(r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{")
VOID = frozenset("br hr img input link meta wbr col embed param source".split())
#: A start tag that ends an open element of the same group, up to the nearest of its bounds.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "td", "th"), ("table",))}
BREAKS = frozenset("address article aside blockquote center dd div dl dt fieldset figcaption figure footer form header main nav ol p pre section table tr ul li h1 h2 h3 h4 h5 h6".split())


class Element:
    """A node of the tree: parts are strings and elements; tags, chars and their link shares are those of the subtree.

    kind is that of the tag, None for the body. A leaf of Markdown, wiki or LaTeX has its shown text as part and stands for `source`.
    """

    __slots__ = ("name", "attrs", "parent", "parts", "kind", "source", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, attrs: str = "", parent: Element | None = None, kind: str | None = None, source: str | None = None) -> None:
        self.name, self.attrs, self.parent, self.parts, self.kind, self.source = name, attrs, parent, [], kind, source
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        if parent is not None:
            parent.parts.append(self)


def measure(root: Element) -> None:
    """Composite text density of every node, and the sum of its children's."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Element)]
    for node in reversed(order):
        node.chars += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        node.tags += 1
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = root
    share = body.link_chars / max(1, body.chars)
    for node in order:
        c, t, lc, lt = node.chars, node.tags, max(1, node.link_chars), max(1, node.link_tags)
        other = max(1, c - node.link_chars)
        base = math.log(c / other * node.link_chars + share * c + math.e)
        node.density = (c / t) * math.log(max(1.0, c / lc * t / lt) + 1e-9) / base if c else 0.0
        if node.parent is not None:
            node.parent.total += node.density


def select(root: Element) -> tuple[set[int], float]:
    """(the elements of the selected subtree by id, threshold): the subtree of the node with the largest sum of child densities, and the smallest density on
    the path from that node up to the body."""
    best, todo = root, [root]
    while todo:
        node = todo.pop()
        if node.total > best.total:
            best = node
        todo += [p for p in node.parts if isinstance(p, Element)]
    inside, todo, least = set(), [best], best.density
    while todo:
        node = todo.pop()
        inside.add(id(node))
        todo += [p for p in node.parts if isinstance(p, Element)]
    while best.parent is not None:
        best = best.parent
        least = min(least, best.density)
    return inside, least


def marks(text: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, kind, whether it is a link, shown text) of the pieces of Markdown, wiki and LaTeX of a text, by start."""
    out = []
    if any(x in text for x in ("](", "][", "]:", "[^", "*", "~~", "__", ":::", "--", "[ ]", "[x]", "[X]", "\n|")) or text.startswith("|"):
        out += [(m.start(), m.end(), "markdown", m["text"] is not None or m["ref"] is not None, _markdown(m)) for m in MARKDOWN.finditer(text)]
    if any(x in text for x in ("''", "[[", "{{", "==", "{|", "|}", "|-", "!!", "||", "[http", "TOC__", "<")):
        out += [(m.start(), m.end(), "wiki", m["link"] is not None or m["named"] is not None, _wiki(m)) for m in WIKI.finditer(text)]
    if "\\" in text or "$" in text:
        out += [(m.start(), m.end(), "latex", False, _latex(m)) for m in LATEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], -x[1]))


def tree(text: str) -> Element:
    """The tree of a text's markup: HTML elements nest, all else is a leaf. Comments hold nothing, entities their text.

    A piece of Markdown, wiki or LaTeX that crosses an HTML tag or another piece counts as a tag, and its text stays with the element around it.
    """
    root = Element("body")
    node, at = root, 0
    html_tags = list(HTML.finditer(text)) if "<" in text or "&" in text else []
    others = marks(text)
    ends = [m.end() for m in html_tags]
    n = 0

    def leaves(until: int) -> None:
        """Append the leaves that start before a position to the open element, and the text between them."""
        nonlocal at, n
        while n < len(others) and others[n][0] < until:
            start, end, kind, link, shown = others[n]
            n += 1
            i = bisect.bisect_right(ends, start)
            if start < at or (i < len(ends) and html_tags[i].start() < end):
                Element("a" if link else kind, "", node, kind, "")
                continue
            if start > at:
                node.parts.append(text[at:start])
            Element("a" if link else kind, "", node, kind, text[start:end]).parts.append(shown)
            at = end
        if until > at:
            node.parts.append(text[at:until])
            at = until

    for m in html_tags:
        leaves(m.start())
        at = m.end()
        name = m[2]
        if name is None:
            leaf = Element(m[0][0], "", node, "html")
            if m[0][0] == "&":
                leaf.parts.append(html.unescape(m[0]).replace("\xa0", " "))
            continue
        name = name.lower()
        if m[1]:
            up = node
            while up is not None and up.name != name:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            else:
                Element(f"/{name}", "", node, "html")  # it closes nothing
            continue
        if name in ENDS:
            same, bounds = ENDS[name]
            up = node
            while up.parent is not None and up.name not in bounds and up.name not in same:
                up = up.parent
            if up.name in same:
                node = up.parent
                while name == "tr" and node.name in same:
                    node = node.parent
        new = Element(name, m[3] or "", node, "html")
        if name not in VOID and not (m[3] or "").endswith("/"):
            node = new
    leaves(len(text))
    return root


def kinds_of(root: Element) -> list[str]:
    """The kinds of the tags counted in a tree."""
    found, todo = set(), [root]
    while todo:
        node = todo.pop()
        found.add(node.kind)
        todo += [p for p in node.parts if isinstance(p, Element)]
    return [k for k in KINDS if k in found]


def render(root: Element) -> str:
    """Clean text of a measured tree: headings, items, rows, code and images' texts in the tables' own form.

    The selected subtree stays whole; outside it, groups of links below the threshold are left out. Elements are written from the innermost outwards, without recursion.
    """
    selected, least = select(root)
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Element)]
    inner: dict[int, str] = {}
    for node in reversed(order):
        out = []
        for part in node.parts:
            if isinstance(part, str):
                out.append(part)
            elif part.source is not None:
                out.append(part.source)
            elif part.name in BREAKS and id(part) not in selected and part.density < least and part.link_chars > 0.5 * part.chars > 0:
                continue  # a group of links outside the selected subtree
            else:
                out.append(written(part, inner))
        inner[id(node)] = "".join(out)
    return inner[id(root)]


def written(e: Element, inner: dict[int, str]) -> str:
    """An element in the tables' own form, given what it and its children hold."""
    name, text = e.name, inner[id(e)]
    if name in ("script", "style", "head", "noscript", "template"):
        return ""
    if name == "br":
        return "\n"
    if name == "img":
        alt = re.search(r"""\balt\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", e.attrs, re.I)
        return html.unescape(alt[1].strip("\"'")) if alt else ""
    if name == "tr":
        return "\n" + " | ".join(" ".join(inner[id(c)].split()) for c in e.parts if isinstance(c, Element) and c.name in ("td", "th")) + "\n"
    if re.fullmatch(r"h[1-6]", name):
        return f"\n\n{'#' * int(name[1])} {' '.join(text.split())}\n\n"
    if name == "li":
        return f"\n- {text.strip()}\n"
    if name == "pre":
        return f"\n```\n{text.strip(chr(10))}\n```\n"
    if name in ("code", "kbd", "samp") and text.strip() and "`" not in text:
        return f"`{text}`"
    return f"\n{text}\n" if name in BREAKS else text


def _markdown(m: re.Match) -> str:
    g = m.groupdict()
    if g["task"] is not None:
        return g["task"]
    if g["row"] is not None:
        return " | ".join(c.strip() for c in g["row"].split("|"))
    for k in ("alt", "text", "ref", "bold", "emph", "gone", "strong", "note"):
        if g[k] is not None:
            return g[k]
    return ""


def _wiki(m: re.Match) -> str:
    g = m.groupdict()
    if g["heading"] is not None:
        return f"{'#' * len(g['level'])} {g['heading'].strip()}"
    if g["head"] is not None:
        return " | ".join(c.strip() for c in g["head"].split("!!"))
    if g["cells"] is not None:
        return " | ".join(c.strip() for c in g["cells"].split("||"))
    return g["quoted"] or g["link"] or g["named"] or ""


def _latex(m: re.Match) -> str:
    g = m.groupdict()
    if g["formula"] is not None:
        return m[0]
    if g["title"] is not None:
        return f"{'#' * (2 + g['level'].count('sub'))} {g['title']}"
    if g["indent"] is not None:
        return f"{g['indent']}- "
    if g["body"] and m[0].startswith("\\footnote"):
        return f" ({g['body']})"
    return g["body"] or ""


def segments(text: str) -> list[tuple[bool, str]]:
    """(inside a fence, text) of the runs of lines of a text."""
    if "```" not in text and "~~~" not in text:
        return [(False, text)]
    out: list[tuple[bool, list[str]]] = []
    for _, line, inside in fenced(text.split("\n")):
        if not out or out[-1][0] != inside:
            out.append((inside, []))
        out[-1][1].append(line)
    return [(inside, "\n".join(lines)) for inside, lines in out]


def settled(text: str, change: Callable[[str], str]) -> str:
    """A text after as many changes as change it."""
    while (changed := change(text)) != text:
        text = changed
    return text


def clean(text: str) -> tuple[list[str], str]:
    """(kinds, clean text) of a text."""
    parts = segments(text)
    held: list[str] = []
    body = "\n".join(x for inside, x in parts if not inside)
    if "`" in body:
        body = CODE.sub(" ", body)
    root = tree(body)
    kinds = kinds_of(root)
    if not kinds:
        return [], text

    def hold(m: re.Match) -> str:
        held.append(m[0])
        return f"\x00{len(held) - 1}\x00"

    out = []
    for inside, x in parts:
        if inside:
            held.append(x)
            out.append(f"\x00{len(held) - 1}\x00")
        else:
            out.append(CODE.sub(hold, x.replace("\x00", "")))
    whole = "\n".join(out)
    if "latex" in kinds:
        whole = settled(whole, lambda x: LATEX.sub(lambda m: hold(m) if m["formula"] is not None else m[0] if OPENED.fullmatch(m[0]) else _latex(m), x))  # innermost first
        whole = LATEX.sub(lambda m: hold(m) if m["formula"] is not None else _latex(m), whole)  # what is never closed
    if "html" in kinds:
        def plain(x: str) -> str:
            if not HTML.search(x):
                return x
            top = root if x == body else tree(x)
            measure(top)
            return render(top)

        whole = settled(whole, plain)  # escaped tags become tags, which are taken out in turn
    if "wiki" in kinds:
        whole = WIKI.sub(_wiki, whole)
    if "markdown" in kinds:
        whole = settled(whole, lambda x: MARKDOWN.sub(_markdown, x))
    for _ in range(len(held) + 1):
        if "\x00" not in whole:
            break
        whole = re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], whole)
    whole = re.sub(r"[ \t\r]+\n", "\n", whole)
    return kinds, re.sub(r"\n{3,}", "\n\n", whole).strip("\n")


def clean_markup(df: DataFrame) -> DataFrame:
    """(record_table, record_id, kinds array<string>, clean_text) of each row of df(record_table, record_id, text)."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [clean(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k for k, _ in done], pa.list_(pa.string())), pa.array([x for _, x in done], pa.string())], names=["record_table", "record_id", "kinds", "clean_text"])

    return spread(df.select("record_table", "record_id", "text")).mapInArrow(run, "record_table string, record_id string, kinds array<string>, clean_text string")

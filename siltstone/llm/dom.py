"""A small tolerant HTML tree, built from tags by one regular expression."""

from __future__ import annotations

import html
import re

#: Elements that never have content (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not shown.
HIDDEN = "head|script|style|noscript|template|svg"
#: Inline elements that do not part a piece of text.
INLINE = frozenset("a b i em strong code span small sup kbd".split())
#: A start tag that closes an open element of the same group, up to the nearest of its bounds (fixed values of HTML).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
#: Block elements.
BLOCKS = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no blocks: the start of a block closes them.
UNNESTED = frozenset("p h1 h2 h3 h4 h5 h6".split())
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({HIDDEN})\b[^<>]*>.*?(?:</\1\s*>|(?=<body\b)|\Z)|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^<>]*>", re.I | re.S)


class Node:
    """An element: tag, attribute text, parent, children (elements) and the numbers of the text pieces that lie directly in it."""

    __slots__ = ("tag", "attrs", "parent", "children", "units", "chars", "linked", "score", "tags")

    def __init__(self, tag: str, attrs: str, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children, self.units = tag, attrs, parent, [], []
        self.chars = self.linked = self.tags = 0
        self.score = 0.0
        if parent is not None:
            parent.children.append(self)

    def walk(self):  # noqa: ANN201
        """The nodes of the subtree, parents first."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))


class Page:
    """The tree of a page and its units: the pieces of visible text between two tags, without those that hold only blanks.

    texts[i], linked[i] (characters of unit i inside links and buttons) and at[i], the node that unit i lies in.
    """

    def __init__(self, source: str) -> None:
        self.root = Node("body", "", None)
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.at: list[Node] = []
        open_node, piece, links, in_link, here = self.root, [], 0, 0, None
        position = 0

        def flush() -> None:
            nonlocal links
            if piece:
                text = "".join(piece)
                if text.strip():
                    node = here if here is not None else open_node
                    node.units.append(len(self.texts))
                    self.texts.append(text)
                    self.linked.append(links)
                    self.at.append(node)
                piece.clear()
            links = 0

        for m in TAG.finditer(source):
            if m.start() > position:
                text = source[position : m.start()]
                if "&" in text:
                    text = html.unescape(text)
                if not piece:
                    here = open_node
                piece.append(text)
                if in_link:
                    links += len(text.strip())
            position = m.end()
            tag = m[3]
            if tag is None:
                if m[1] is not None:
                    flush()
                continue
            tag = tag.lower()
            if tag in INLINE:
                if tag == "a":
                    in_link = 0 if m[2] else 1
                continue
            flush()
            if m[2]:
                node = open_node
                if tag in BLOCKS and node.tag != tag and node.tag in HEADINGS:
                    open_node = node.parent  # a heading closed by the wrong tag
                    continue
                while node is not None and node.tag != tag:
                    node = node.parent
                if node is not None and node.parent is not None:
                    open_node = node.parent
                if tag == "button":
                    in_link = 0
                continue
            if tag in ("html", "body"):
                continue
            if tag in CLOSES:
                same, bounds = CLOSES[tag]
                node = open_node
                while node.parent is not None and node.tag not in bounds and node.tag not in same:
                    node = node.parent
                if node.tag in same:
                    open_node = node.parent
            elif tag in BLOCKS and open_node.tag in UNNESTED:
                open_node = open_node.parent
            node = Node(tag, m[4], open_node)
            if tag not in VOID and not m[4].endswith("/"):
                open_node = node
            if tag == "button":
                in_link = 1
        if position < len(source):
            if not piece:
                here = open_node
            piece.append(html.unescape(source[position:]))
        flush()


def decode(body: bytes | None) -> str:
    """UTF-8 with replacement, without a leading byte order mark."""
    return body.decode("utf-8", "replace").lstrip("﻿") if body else ""

"""HTML as a tree, with the few selectors that source definitions use."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("pre", "code"))


class Element:
    __slots__ = ("name", "attrs", "parent", "children")

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def elements(self) -> Iterator[Element]:
        """The elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]

    def strings(self) -> Iterator[str]:
        todo: list[Element | str] = [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                yield e
            else:
                todo += reversed(e.children)

    def text(self, between: str = "") -> str:
        """All text; with `between`, of the trimmed non-blank pieces."""
        return between.join(s.strip() for s in self.strings() if s.strip()) if between else "".join(self.strings())

    def find(self, name: str) -> Element | None:
        return next((e for e in self.elements() if e.name == name), None)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(e)
        if tag not in VOID:
            self.open = e

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.open))

    def handle_endtag(self, tag: str) -> None:
        e: Element | None = self.open
        while e is not None and e.name != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.open = e.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)


#: What the quick reader takes: text, start tags with plain attributes, end tags, comments, a doctype. Anything on which versions of the standard reader differ is left to it.
BLANK = r"[ \t\n\r\f]"
TOKEN = re.compile(rf"""([^<]+)|<(?:([a-zA-Z][a-zA-Z0-9]*)((?:{BLANK}+[a-zA-Z][\w-]*(?:=(?:"[^"]*"|'[^']*'|[\w#.:-]+(?=[\s>])))?)*){BLANK}*(/?)>|/([a-zA-Z][a-zA-Z0-9]*){BLANK}*>|!--[^-<>]+(?:-[^-<>]+)*-->|!(?i:doctype)[^<>]*>)""", re.ASCII)
ATTR = re.compile(r"""([a-zA-Z][\w-]*)(?:=(?:"([^"]*)"|'([^']*)'|([\w#.:-]+)))?""", re.ASCII)
#: Elements whose content has rules of its own, some of them in some versions only, and what the quick reader takes of it up to the end tag.
OWN = {name: re.compile(rf"([^<]*(?:<(?![/!])[^<]*)*)</{name}{BLANK}*>", re.I | re.ASCII) for name in ("script", "style")} | dict.fromkeys("textarea xmp iframe noembed noframes noscript plaintext".split())
TITLE = re.compile(rf"[^<]*</title{BLANK}*>", re.I | re.ASCII)


def quick(source: str) -> Element | None:
    """The tree of a page of plain tokens, the same that _Builder gives; None for a page with anything else in it."""
    root = at = Element("", {}, None)
    pos, end, match = 0, len(source), TOKEN.match
    while pos < end:
        m = match(source, pos)
        if m is None:
            return None
        pos = m.end()
        kind = m.lastindex
        if kind == 1:
            at.children.append(html.unescape(m[1]))
        elif kind == 5:
            name = m[5].lower()
            e: Element | None = at
            while e is not None and e.name != name:
                e = e.parent
            if e is not None and e.parent is not None:
                at = e.parent
        elif kind is not None:
            name, attrs = m[2].lower(), {}
            if m[3]:
                for key, *values in ATTR.findall(m[3]):
                    attrs[key.lower()] = html.unescape("".join(values))
            e = Element(name, attrs, at)
            at.children.append(e)
            if m[4] and (name in OWN or name == "title"):
                return None
            if m[4] or name in VOID:
                continue
            at = e
            if name == "title" and not TITLE.match(source, pos):
                return None
            if name in OWN:
                raw = OWN[name] and OWN[name].match(source, pos)
                if not raw:
                    return None
                if raw[1]:
                    e.children.append(raw[1])
                at, pos = e.parent, raw.end()
    return root


def parse(source: str | bytes | None) -> Element:
    """The tree of a page. Unclosed elements hold what follows; unmatched ends are ignored; comments hold nothing."""
    if isinstance(source, bytes):
        source = source.decode("utf-8", "replace")
    source = (source or "").lstrip("﻿")
    root = quick(source)
    if root is None:
        builder = _Builder()
        builder.feed(source)
        builder.close()
        root = builder.root
    return root


SIMPLE = re.compile(r"([A-Za-z][\w-]*)?((?:\.[\w-]+|#[\w-]+|\[[\w-]+(?:=(?:'[^']*'|\"[^\"]*\"|[^\]]*))?\])*)$")
PIECE = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:=(?:'([^']*)'|\"([^\"]*)\"|([^\]]*)))?\]")


class Simple:
    """A tag, .class, #id, [attr], [attr='v'] or a row of them, read once."""

    __slots__ = ("name", "classes", "attrs")

    def __init__(self, name: str, pieces: list[tuple[str, ...]]) -> None:
        self.name = name.lower()
        self.classes = [cls for cls, *_ in pieces if cls]
        self.attrs = [("id", ident) for _, ident, *_ in pieces if ident] + [(attr, next((v for v in values if v), None)) for _, _, attr, *values in pieces if attr]

    def matches(self, e: Element) -> bool:
        if self.name and self.name != e.name:
            return False
        if self.classes and not ("class" in e.attrs and set(self.classes) <= set(e.classes)):
            return False
        return all(attr in e.attrs and (want is None or e.attrs[attr] == want) for attr, want in self.attrs)


@functools.cache
def simple(text: str) -> Simple | None:
    """The parts of a selector without blanks; None for another form, which matches nothing."""
    m = SIMPLE.match(text)
    return Simple(m[1] or "", PIECE.findall(m[2])) if m and text else None


class Selectors:
    """A row of selectors, read once, so that one walk over a tree asks each element for all of them; a blank between parts means descent. Selectors of another form match
    nothing."""

    def __init__(self, selectors: Iterable[str]) -> None:
        self.tags: dict[str, int] = {}  # the places of those that are a tag and no more
        self.others: list[tuple[int, Simple, list[Simple]]] = []
        for place, selector in enumerate(selectors):
            parts = [simple(part) for part in re.findall(r"(?:\[[^\]]*\]|\S)+", selector) or [""]]
            if None in parts:
                continue
            *above, last = parts
            if above or last.classes or last.attrs:
                self.others.append((place, last, above))
            else:
                self.tags.setdefault(last.name, place)
        self.without_attrs = [x for x in self.others if not (x[1].classes or x[1].attrs)]

    def first(self, e: Element) -> int | None:
        """The place of the first selector that matches an element."""
        found = self.tags.get(e.name)
        for place, last, above in self.others if e.attrs else self.without_attrs:
            if found is not None and place > found:
                break
            if last.matches(e) and self.below(e, above):
                return place
        return found

    @staticmethod
    def below(e: Element, above: list[Simple]) -> bool:
        """Whether an element lies below elements that match, in that order."""
        at, need = e.parent, len(above)
        while need and at is not None:
            need -= above[need - 1].matches(at)
            at = at.parent
        return not need


def select(root: Element, selector: str) -> Iterator[Element]:
    """The elements below root that match a selector."""
    asked = Selectors([selector])
    return (e for e in root.elements() if asked.first(e) is not None)

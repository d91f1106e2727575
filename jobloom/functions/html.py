"""Fields of captured HTML pages, by the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "li", "ul", "ol", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table"}
DETAIL = "company string, job_title string, level string, location string, description string"


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[_Node | str] = []

    def walk(self) -> Iterator[_Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, _Node)]

    def find_all(self, tag: str, name: str | None = None) -> Iterator[_Node]:
        """Descendants with the tag and, if given, all classes of ``name``."""
        wanted = set((name or "").split())
        return (n for n in self.walk() if n.tag == tag and wanted <= set(n.attrs.get("class", "").split()))

    def find(self, tag: str, name: str | None = None) -> _Node | None:
        return next(self.find_all(tag, name), None)

    def strings(self) -> Iterator[str]:
        stack: list[_Node | str] = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in ("script", "style"):
                stack += reversed(node.children)

    def text(self) -> str:
        return "".join(self.strings()).strip()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self._at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs}, self._at)
        self._at.children.append(node)
        if tag not in _VOID:
            self._at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._at.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self._at))

    def handle_endtag(self, tag: str) -> None:
        at: _Node | None = self._at
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self._at = at.parent

    def handle_data(self, data: str) -> None:
        self._at.children.append(data)


def parse(html: str | None) -> _Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _inner(node: _Node | None) -> str | None:
    return (node.text() or None) if node else None


def posting_urns(html: str | None) -> list[str]:
    """URNs of the cards on a search page, in their order."""
    cards = (li.find("div", "base-card") for li in parse(html).find_all("li"))
    return [c.attrs["data-entity-urn"] for c in cards if c is not None and c.attrs.get("data-entity-urn")]


def posting_fields(html: str | None) -> dict[str, str | None]:
    """Company, title, level, location and description of a detail page; each has its chain of places to look.

    The names of tags and classes are fixed values: the pages have them.
    """
    root = parse(html)
    card = root.find("div", "top-card-layout__card")
    image = next((i for a in (card.find_all("a") if card else ()) for i in a.find_all("img")), None)
    company = (image.attrs.get("alt", "").strip() or None) if image else None
    company = company or _inner(root.find("a", "topcard__org-name-link")) or _inner(root.find("span", "topcard__flavor"))
    info = root.find("div", "top-card-layout__entity-info")
    title = _inner(info.find("a") if info else None) or _inner(root.find("h1", "top-card-layout__title"))
    level = None
    criteria = root.find("ul", "description__job-criteria-list")
    for item in criteria.find_all("li") if criteria else ():
        if "Seniority level" in (_inner(item.find("h3", "description__job-criteria-subheader")) or ""):
            level = _inner(item.find("span", "description__job-criteria-text"))
            break
    row = root.find("div", "topcard__flavor-row")
    location = _inner(root.find("span", "topcard__flavor topcard__flavor--bullet")) or _inner(row.find("span", "topcard__flavor") if row else None)
    body = root.find("div", "show-more-less-html__markup")
    lines = [line for s in (body.strings() if body else ()) for line in s.strip().splitlines() if line.strip()]
    return {"company": company, "job_title": title, "level": level, "location": location, "description": "\n".join(lines) or None}


def plain_text(html: str | None) -> str | None:
    """Text of an HTML fragment, a line for each block; null stays null."""
    if html is None:
        return None
    out: list[str] = []
    # a stack of its own: pages may nest deeper than Python recurses
    stack: list[_Node | str | None] = [parse(html)]
    while stack:
        node = stack.pop()
        if node is None:
            out.append("\n")
        elif isinstance(node, str):
            out.append(node.replace("\n", " "))
        elif node.tag in _BLOCK:
            out.append("\n")
            stack += [None, *reversed(node.children)]
        elif node.tag not in ("script", "style"):
            stack += reversed(node.children)
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def urns_of(html: Column) -> Column:
    @F.pandas_udf("array<string>")
    def urns(pages: pd.Series) -> pd.Series:
        return pages.map(posting_urns)

    return urns(html)


def fields_of(html: Column) -> Column:
    @F.pandas_udf(DETAIL)
    def fields(pages: pd.Series) -> pd.DataFrame:
        names = ["company", "job_title", "level", "location", "description"]
        return pd.DataFrame([posting_fields(p) for p in pages], columns=names, dtype=object)

    return fields(html)


def text_of(html: Column) -> Column:
    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(plain_text)

    return text(html)

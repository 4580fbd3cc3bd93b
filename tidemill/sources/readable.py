"""The readable body of web pages, by the structure of their HTML."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What is taken out of a page, and where its text is looked for, in this order.
NOISE = ["script", "style", "nav", "header", "footer", "aside", "form", ".sidebar", ".comments", ".related", ".newsletter", ".advertisement"]
CONTENT = ["article", "main", "[role=main]", ".post-content", ".article-content", ".entry-content", "#content", ".content"]
LEAST_PARAGRAPHS, LEAST_TEXT = 400, 40
#: Pages that a task holds at a time.
PIECE = 64
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class _Node:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None) -> None:
        self.tag, self.attrs, self.parts, self.parent = tag, attrs, [], parent

    def matches(self, selector: str) -> bool:
        if selector[0] == ".":
            return selector[1:] in (self.attrs.get("class") or "").split()
        if selector[0] == "#":
            return self.attrs.get("id") == selector[1:]
        return self.attrs.get("role") == "main" if selector[0] == "[" else self.tag == selector


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def _close(self, tag: str) -> None:
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def _open_p(self) -> bool:
        node = self.at
        while node.parent and node.tag not in ("p", "article", "body", "button", "td", "th"):
            node = node.parent
        return node.tag == "p"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES_P and self._open_p():
            self._close("p")
        if tag == "li" and self.at.tag == "li":
            self._close("li")
        node = _Node(tag, dict(attrs), self.at)
        self.at.parts.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def _walk(root: _Node) -> tuple[list[_Node], dict[int, str]]:
    """Nodes in document order, without noise, and the text of each; without recursion, as pages may nest deeply."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.parts = [x for x in node.parts if isinstance(x, str) or not any(x.matches(s) for s in NOISE)]
        order.append(node)
        stack += [x for x in reversed(node.parts) if isinstance(x, _Node)]
    text: dict[int, str] = {}
    for node in reversed(order):
        text[id(node)] = "".join(x if isinstance(x, str) else text[id(x)] for x in node.parts)
    return order, text


def readable(html: str | None) -> str | None:
    """Paragraphs, list items and headings of over LEAST_TEXT characters in the first element of CONTENT whose paragraphs
    have over LEAST_PARAGRAPHS characters, else in the whole page; null without any."""
    if not html:
        return None
    tree = _Tree()
    tree.feed(html)
    tree.close()
    order, text = _walk(tree.root)

    def inside(top: _Node, tags: tuple[str, ...]) -> list[_Node]:
        held, out = {id(top)}, []
        for n in order:
            if n is not top and n.parent is not None and id(n.parent) in held:
                held.add(id(n))
                if n.tag in tags:
                    out.append(n)
        return out

    places = (next((n for n in order if n.matches(s)), None) for s in CONTENT)
    best = next((n for n in places if n is not None and sum(len(text[id(p)]) for p in inside(n, ("p",))) > LEAST_PARAGRAPHS), None)
    parts = [text[id(n)].strip() for n in inside(best or tree.root, ("p", "li", "h2", "h3"))]
    return "\n\n".join(p for p in parts if len(p) > LEAST_TEXT) or None


@F.arrow_udf(StringType())
def readable_body(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """PIECE pages at a time, whatever the size of Spark's batches; nodes and their parents name each other, so a page's tree
    stays until garbage is collected."""
    for pages in batches:
        for i in range(0, len(pages), PIECE):
            yield pa.array(map(readable, pages.slice(i, PIECE).to_pylist()), pa.string())
            gc.collect()

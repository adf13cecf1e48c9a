"""HTML documents to titled sections and plain text, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chapters import HEADING_LINES, SKIPPED_TITLES

BLOCKS = {"p", "div", "blockquote", "pre"}
#: Characters of results that leave a task at once.
OUT_CHARS = 1 << 20
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
_SKIP = re.compile(r"\b(?:" + "|".join(SKIPPED_TITLES) + r")\b", re.I)
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
_HEAD = re.compile(r"^(?:" + "|".join(HEADING_LINES) + r"|\d+\.\s+)", re.I | re.M)


class Node:
    __slots__ = ("name", "children")

    def __init__(self, name: str):
        self.name, self.children = name, []

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.name not in ("script", "style"):
                yield from c.strings()

    def text(self) -> str:
        return "".join(s.strip() for s in self.strings())


class _Tree(HTMLParser):
    """A tree of the document; a ``p`` ends where another block starts, stray end tags go."""

    def __init__(self):
        super().__init__()
        self.open = [Node("")]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS | {"h1", "h2", "ul", "ol"} and self.open[-1].name == "p":
            self.open.pop()
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag))

    def handle_endtag(self, tag):
        if any(n.name == tag for n in self.open[1:]):
            while self.open.pop().name != tag:
                pass

    def handle_data(self, data):
        self.open[-1].children.append(data)


def closed_references(html: str | None) -> str:
    """The document with references that a semicolon ends, all other ampersands being text."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html or "")


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.open[0]


def element_text(node: Node, keep_lines: bool = True) -> str:
    """Text of an element: verse keeps its lines, all else is joined by blanks."""
    if keep_lines and node.name in ("pre", "blockquote"):
        return "\n".join(node.strings()).strip()
    return " ".join(s.strip() for s in node.strings() if s.strip())


def full_text(root: Node) -> str:
    """Texts of all blocks in document order (a block within a block is told twice), else all text."""
    _without(root, {"script", "style", "nav"})
    parts = [t for t in (element_text(n) for n in root.walk() if n.name in BLOCKS) if t]
    return "\n\n".join(parts or [s.strip() for s in root.strings() if s.strip()])


def _without(node: Node, names: set[str]) -> None:
    node.children = [c for c in node.children if isinstance(c, str) or c.name not in names]
    for c in node.children:
        if isinstance(c, Node):
            _without(c, names)


def title_of(root: Node) -> str:
    """The first heading or title that isn't empty."""
    for name in ("h1", "h2", "title"):
        found = next((n for n in root.walk() if n.name == name), None)
        if found and found.text():
            return found.text()
    return ""


def is_skipped(root: Node) -> bool:
    title = title_of(root)
    return bool(_SKIP.search(title)) if title else len(root.text()) < 50


def by_headings(root: Node) -> list[tuple[str, str]]:
    """Sections of each h1/h2: the elements beside it up to the next one."""
    out = []
    for parent in [root, *root.walk()]:
        for i, node in enumerate(parent.children):
            if isinstance(node, Node) and node.name in ("h1", "h2") and not _SKIP.search(node.text()):
                parts = []
                for c in parent.children[i + 1 :]:
                    if isinstance(c, Node):
                        if c.name in ("h1", "h2"):
                            break
                        parts.append(element_text(c))
                text = "\n\n".join(p for p in parts if p)
                if text.strip():
                    out.append((node.text(), text))
    return out


def by_patterns(text: str) -> list[tuple[str, str]]:
    """Sections of plain text that start at lines such as "Chapter 3"."""
    found = list(_HEAD.finditer(text))
    ends = [m.start() for m in found[1:]] + [len(text)]
    cut = [(m[0].strip(), text[m.start() : end].partition("\n")[2].strip()) for m, end in zip(found, ends)]
    return [(t, body) for t, body in cut if body]


def document_sections(html: str | None, strategy: str = "auto") -> list[tuple[str, str]]:
    """Titled sections of a document: by headings, else by patterns, else the whole text."""
    root = parse(html)
    if is_skipped(root):
        return []
    out = by_headings(root) if strategy in ("auto", "heading") else []
    if not out and strategy in ("auto", "pattern"):
        out = by_patterns(full_text(parse(html)))
    return out or ([("", full_text(parse(html)))] if strategy in ("auto", "none") else [])


def told(batches: Iterator[pa.RecordBatch], of: Callable[[str | None], list[tuple]], fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """The rows that ``of`` makes of each document, the last column, after its keys, the others.

    One document at a time is a Python string and a tree, and results leave by ``OUT_CHARS``, so that memory grows
    neither with the rows of an Arrow batch nor with those of a task.
    """
    for batch in batches:
        *keys, html = batch.columns
        take, rows, held = [], [], 0
        for i, h in enumerate(html):
            own = of(h.as_py())
            take += [i] * len(own)
            rows += own
            held += sum(len(x) for row in own for x in row if isinstance(x, str))
            if rows and (held > OUT_CHARS or i == len(html) - 1):
                made = [pa.array(c, f.type) for c, f in zip(zip(*rows), fields)]
                yield pa.RecordBatch.from_arrays([*(k.take(pa.array(take)) for k in keys), *made], names=[*batch.schema.names[:-1], *(f.name for f in fields)])
                take, rows, held = [], [], 0


def _mapped(documents: DataFrame, keys: list[str], html: str, of: Callable[[str | None], list[tuple]], columns: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    types = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [pa.field(name, types[kind]) for name, kind in (c.split() for c in columns.split(", "))]
    return documents.select(*keys, html).mapInArrow(lambda batches: told(batches, of, fields), ", ".join([f"{k} {kinds[k]}" for k in keys] + [columns]))


def sections(documents: DataFrame, keys: list[str], html: str = "html", strategy: str = "auto") -> DataFrame:
    """``(keys, section, title, text)`` of every document that isn't skipped."""
    return _mapped(documents, keys, html, lambda h: [(i, t, x) for i, (t, x) in enumerate(document_sections(h, strategy))], "section int, title string, text string")


def outlines(documents: DataFrame, keys: list[str], html: str = "html", open_references: bool = True) -> DataFrame:
    """``(keys, title, skipped, text)``: title, whether the document is skipped, and its full text.

    References without a semicolon, such as ``&amp`` where a heading was cut off, are read as HTML does, or without
    ``open_references`` stay as they are, as in XHTML.
    """

    def of(h: str | None) -> list[tuple]:
        root = parse(h if open_references else closed_references(h))
        return [(title_of(root), is_skipped(root), full_text(root))]

    return _mapped(documents, keys, html, of, "title string, skipped boolean, text string")


def native_title(html: str = "html"):
    """The h1 of a page by patterns alone, for pages whose headings hold no other tags."""
    t = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(t)

"""Page scan: a table of HTML pages to labelled facts and hidden sections.

HTML needs a real tokenizer, so this is the one place where Python runs on the executors;
everything after the scan is DataFrame work. A page is read whole, one page at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

from pyspark.sql import DataFrame

SCHEMA = "page_id bigint, kind string, seq int, label string, value string"
LABEL_TAGS = {"b", "strong", "dt"}
VOID_TAGS = {"br", "img", "hr", "input", "meta", "link", "area", "col", "source", "wbr"}
SILENT_TAGS = {"script", "style"}
# Elements a new element of the same row closes when it was left open.
CLOSES = {
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
}
CLOSE_STOP = {"table", "ul", "ol", "dl", "div", "article", "body"}
SECTION_CLASSES = {"spoiler", "sp-wrap", "hidewrap"}
HEAD_CLASSES = {"sp-head", "spoiler-title", "hidehead"}
BODY_CLASSES = {"sp-body", "spoiler-body", "spoiler-content", "hidebody"}
SPACE = re.compile(r"\s+")
ROWS_AT_ONCE = 2_000


class Node:
    __slots__ = ("tag", "classes", "parent", "children", "place")

    def __init__(self, tag, classes=(), parent=None):
        self.tag, self.classes, self.parent, self.children = tag, set(classes), parent, []
        self.place = len(parent.children) if parent is not None else 0

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def take_apart(self) -> None:
        stack = [self]
        while stack:
            node = stack.pop()
            stack.extend(c for c in node.children if isinstance(c, Node))
            node.parent, node.children = None, []

    def find(self, classes):
        return next((n for n in self.walk() if n is not self and n.classes & classes), None)

    def inside(self, classes) -> bool:
        node = self
        while node is not None:
            if node.classes & classes:
                return True
            node = node.parent
        return False


class TreeBuilder(HTMLParser):
    """Forgiving tree of a page: unclosed elements end where their parent does."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("root")

    def handle_starttag(self, tag, attrs):
        for closed in (CLOSES.get(tag) or ()):
            self._close(closed, CLOSE_STOP)
        classes = next((v for k, v in attrs if k == "class" and v), "").split()
        node = Node(tag, classes, self.here)
        self.here.children.append(node)
        if tag not in VOID_TAGS:
            self.here = node

    def handle_endtag(self, tag):
        self._close(tag, ())

    def handle_data(self, data):
        if self.here.tag not in SILENT_TAGS:
            self.here.children.append(data)

    def _close(self, tag, stop):
        node = self.here
        while node.parent is not None and node.tag != tag:
            if node.tag in stop:
                return
            node = node.parent
        if node.parent is not None:
            self.here = node.parent


def text_of(node, breaks: bool = False) -> str:
    """Text below a node; white space collapsed, lines kept apart at breaks if asked."""
    parts, stack = [], [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif item.tag == "br":
            parts.append("\n")
        else:
            stack.extend(reversed(item.children))
    text = "".join(parts)
    if not breaks:
        return SPACE.sub(" ", text).strip()
    lines = (SPACE.sub(" ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def following_text(label: Node) -> str:
    """Text after a label up to the next label or line break; one break right after it is crossed."""
    out, crossed = [], False
    for item in islice(label.parent.children, label.place + 1, None):
        if isinstance(item, Node) and item.tag == "br":
            if crossed or clean_value(out):
                break
            out, crossed = [], True
        elif isinstance(item, Node) and item.tag in LABEL_TAGS:
            break
        else:
            out.append(item if isinstance(item, str) else text_of(item))
    return clean_value(out)


def clean_value(parts: list[str]) -> str:
    return SPACE.sub(" ", " ".join(parts)).strip().lstrip(":  ")


def next_element(node: Node) -> Node | None:
    """The element after a node under the same parent."""
    return next((n for n in islice(node.parent.children, node.place + 1, None) if isinstance(n, Node)), None)


def page_rows(html: str) -> Iterator[tuple[str, int, str, str]]:
    """``(kind, seq, label, value)`` rows of one page, in page order per kind."""
    builder = TreeBuilder()
    try:
        builder.feed(html or "")
        builder.close()
        yield from _found(builder.root)
    finally:
        # parents and children hold each other: taken apart, a page is freed at once, not when the collector comes
        builder.here = None
        builder.root.take_apart()


def _found(root: Node) -> Iterator[tuple[str, int, str, str]]:
    seq = 0
    for node in root.walk():
        if node.tag == "tr":
            cells = [n for n in node.walk() if n.tag in ("td", "th")]
            if len(cells) >= 2:
                yield "fact", (seq := seq + 1), text_of(cells[0]), text_of(cells[1])
        elif node.tag in LABEL_TAGS and not node.inside(SECTION_CLASSES):
            label = text_of(node)
            if not label.endswith(":") and node.tag != "dt" and "post-b" not in node.classes:
                continue
            value = following_text(node)
            if node.tag == "dt":
                after = next_element(node)
                if after is not None and after.tag == "dd":
                    value = text_of(after)
            yield "fact", (seq := seq + 1), label, value
        elif node.classes & SECTION_CLASSES:
            head, body = node.find(HEAD_CLASSES), node.find(BODY_CLASSES)
            title = text_of(head) if head is not None else ""
            yield "section", (seq := seq + 1), title, text_of(body or node, breaks=True)


def scan_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Facts and sections of a page table."""

    def scan(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("seq", pa.int32()), ("label", pa.string()), ("value", pa.string())])

        def packed(rows):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

        # texts stay in their batch and become Python texts one page at a time
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows = []
            for i in range(batch.num_rows):
                page = ids[i].as_py()
                rows += [(page, *row) for row in page_rows(texts[i].as_py())]
                if len(rows) >= ROWS_AT_ONCE:
                    yield packed(rows)
                    rows = []
            yield packed(rows)

    return pages.select(key, html).mapInArrow(scan, SCHEMA)

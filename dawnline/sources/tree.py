"""HTML pages as numbered elements over pieces of text, so that grammars of pages are column expressions and range joins.

One pass over a page gives its text as pieces in order and its elements in document order. An element's number is its place;
its descendants are the numbers up to `last`, and its text is the pieces from `at` to before `end`. Whatever lies between two
elements is a slice of the pieces, whether or not the elements are siblings, and the text of disjoint ranges costs no more
than the page. A stack of open elements closes list items, cells, rows and paragraphs whose end tags are missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnline.functions import text
from dawnline.sources.html import VOID
from dawnline.workspace import ready

#: Elements without text, elements that start a line, and what separates cells.
SILENT = frozenset("script style noscript template svg button nav".split())
LINES = frozenset("p div section article li ul ol table tr br h1 h2 h3 h4 h5 h6 pre blockquote details summary dd dt dl header footer".split())
CELL_END = " · "

#: Characters of pages whose trees are held at once by a task; results do not depend on it.
HELD_CHARS = 1 << 20

#: What a start tag closes, if it is open within the given elements.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
}
_PARTED = LINES - {"br"} | {"main", "body", "td", "th"}
ELEMENT = "struct<last: int, parent: int, tag: string, at: int, end: int, ident: string, href: string, ref: string, bold: int, lead: int>"
CELL = "struct<tab: int, row: int, col: int, head: boolean, node: int>"
_ELEMENT = [("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("at", pa.int32()), ("end", pa.int32()), ("ident", pa.string()), ("href", pa.string()), ("ref", pa.string()), ("bold", pa.int32()), ("lead", pa.int32())]
_CELL = [("tab", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("head", pa.bool_()), ("node", pa.int32())]
LAST, PARENT, TAG, AT, END, IDENT, HREF, REF, BOLD, LEAD = range(10)


class Tree(HTMLParser):
    """pieces, elements, cells and root (the number of the main content, -1 for the whole page) of one page.

    Of an element: ident is its id, or the name of a link; ref the first link to a place in the page within it; bold its
    first b or strong, lead its first b, strong or a. A cell's col counts the td of its row; that of a th, the th of its table.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces, self.elements, self.cells = [], [], []
        self.open, self.tables, self.silent = [], [], 0
        self.root, self.rank = -1, 99

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in reversed(attrs)}
        if tag in _CLOSES:
            self._close_within(*_CLOSES[tag])
        if tag in LINES and tag != "br":
            self._close_paragraph()
        node = len(self.elements)
        if tag in LINES and not self.silent:
            self.pieces.append("\n• " if tag == "li" else "\n")
        self._seen(tag, at.get("href", ""), node)
        ident = at.get("id") or (at.get("name") if tag == "a" else None)
        self.elements.append([node, self.open[-1] if self.open else -1, tag, len(self.pieces), len(self.pieces), ident or None, at.get("href"), None, -1, -1])
        self._content(tag, at, node)
        if tag in VOID:
            return
        self.open.append(node)
        if tag in SILENT:
            self.silent += 1
        elif tag == "table":
            self.tables.append([node, -1, -1, -1])  # its number, row, last td of the row, last th
        elif self.tables and tag == "tr":
            self.tables[-1][1:3] = self.tables[-1][1] + 1, -1
        elif self.tables and tag in ("td", "th"):
            table = self.tables[-1]
            table[1], place = max(0, table[1]), 3 if tag == "th" else 2
            table[place] += 1
            self.cells.append((table[0], table[1], table[place], tag == "th", node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            name = self.elements[self.open[i]][TAG]
            if name == tag:
                self._close_to(i)
                return
            if name == "table":
                return

    def handle_data(self, data):
        if not self.silent and data:
            self.pieces.append(data)

    def close(self):
        super().close()
        self._close_to(0)

    def _seen(self, tag, href, node):
        """Note in the open elements what is the first of its kind in them: outer ones have it if inner ones do."""
        wanted = ([BOLD, LEAD] if tag in ("b", "strong") else [LEAD] if tag == "a" else []) + ([REF] if tag == "a" and len(href) > 1 and href[0] == "#" else [])
        for field in wanted:
            for i in reversed(self.open):
                if self.elements[i][field] not in (-1, None):
                    break
                self.elements[i][field] = href[1:] if field == REF else node

    def _content(self, tag, at, node):
        """The main content is the first element of the strongest kind."""
        ident, kinds = at.get("id"), at.get("class", "").split()
        ranks = [tag == "main" and ident == "main", tag == "main", tag == "div" and "content" in kinds, tag == "article", ident == "main-column", tag == "body"]
        rank = ranks.index(True) if True in ranks else 99
        if rank < self.rank:
            self.root, self.rank = node, rank

    def _close_within(self, tags, scopes):
        for i in range(len(self.open) - 1, -1, -1):
            name = self.elements[self.open[i]][TAG]
            if name in tags:
                self._close_to(i)
                return
            if name in scopes:
                return

    def _close_paragraph(self):
        for i in range(len(self.open) - 1, -1, -1):
            name = self.elements[self.open[i]][TAG]
            if name == "p":
                self._close_to(i)
                return
            if name in _PARTED:
                return

    def _close_to(self, i):
        """Close the open elements from the i-th on."""
        while len(self.open) > i:
            element = self.elements[self.open.pop()]
            tag = element[TAG]
            element[LAST], element[END] = len(self.elements) - 1, len(self.pieces)
            if tag in SILENT:
                self.silent -= 1
            elif tag == "table" and self.tables:
                self.tables.pop()
            if not self.silent and tag in ("td", "th"):
                self.pieces.append(CELL_END)
            elif not self.silent and tag in LINES:
                self.pieces.append("\n")


def _lists(rows: list[list], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """An array of lists of structs from lists of tuples."""
    flat = [x for row in rows for x in row]
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    columns = [pa.array([x[i] for x in flat], kind) for i, (_, kind) in enumerate(fields)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in fields]))


def trees(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """id_col, the columns to keep, pieces, elements, cells and root of each page; empty ones for null or empty html."""
    ready(pages.sparkSession)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, chars, done = [], 0, 0
            for at, html in enumerate(batch.column(0), 1):
                told = html.as_py() or ""
                tree = Tree()
                tree.feed(told)
                tree.close()
                found.append(tree)
                chars += len(told)
                # a tree takes many times its page's memory, so that only a few are held at once
                if chars >= HELD_CHARS or at == batch.num_rows:
                    columns = [*batch.slice(done, at - done).columns[1:], pa.array([t.pieces for t in found], pa.list_(pa.string())), _lists([t.elements for t in found], _ELEMENT), _lists([t.cells for t in found], _CELL), pa.array([t.root for t in found], pa.int32())]
                    found, chars, done = [], 0, at
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, *keep, "pieces", "elements", "cells", "root"])

    return pages.select(html_col, id_col, *keep).mapInArrow(run, f"{kinds}, pieces array<string>, elements array<{ELEMENT}>, cells array<{CELL}>, root int")


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \n\t\r"))


def between(at: Column, end: Column) -> Column:
    """The text of the pieces from at to before end, in lines."""
    return trimmed(text.norm_block(F.array_join(F.slice("pieces", at + 1, F.greatest(end - at, F.lit(0))), "")))


def element(node: Column) -> Column:
    """The element of a number, null for -1."""
    return F.when(node >= 0, F.get("elements", node))


def text_of(node: Column) -> Column:
    e = element(node)
    return F.when(e.isNotNull(), between(e["at"], e["end"]))


def in_root(node: Column) -> Column:
    return (node > F.col("root")) & ((F.col("root") < 0) | (node <= element(F.col("root"))["last"]))


def numbered(keep) -> Column:
    """The elements that keep(element, number) accepts, with their numbers: node and the element's fields."""
    fields = [f for f, _ in _ELEMENT]
    every = F.transform("elements", lambda e, i: F.struct(i.alias("node"), *[e[f].alias(f) for f in fields]))
    return F.filter(every, lambda e: keep(e, e["node"]))


def table_cells(where=None) -> Column:
    """The cells of the main content's tables that where accepts: structs of tab, row, col, head, node, text, lead, bold, ref.

    tab is the table's number among the elements; lead and bold are the texts of the first such element of the cell, or empty.
    """

    def told(c: Column) -> Column:
        e = F.get("elements", c["node"])
        return F.struct(
            c["tab"].alias("tab"), c["row"].alias("row"), c["col"].alias("col"), c["head"].alias("head"), c["node"].alias("node"), text_of(c["node"]).alias("text"),
            text.norm_space(text_of(e["lead"])).alias("lead"), text.norm_space(text_of(e["bold"])).alias("bold"), e["ref"].alias("ref"),
        )

    return F.transform(F.filter("cells", lambda c: in_root(c["node"]) if where is None else in_root(c["node"]) & where(c)), told)

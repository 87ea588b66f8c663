"""Raw HTML pages as text, links, tables and dates: one parse of each page gives all of them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnline.workspace import ready

SKIPPED = frozenset("script style noscript template svg nav header footer aside form button".split())
BLOCKS = frozenset("p div section article main ul ol table tr h1 h2 h3 h4 h5 h6 br hr pre blockquote details summary dl dt dd".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: The names of meta elements that tell a page's date, the strongest first.
DATE_NAMES = ["ms.date", "updated_at", "article:modified_time"]
PARSED = "title string, text string, updated string, links array<struct<href: string, text: string>>, cells array<struct<tab: int, row: int, col: int, head: boolean, text: string>>"


class Page(HTMLParser):
    """Text by blocks, links and table cells of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.cells, self.title = [], [], [], ""
        self.dates, self.open_time = {}, None
        self.skip, self.open_link, self.open_cell, self.in_title = 0, None, None, False
        self.table, self.row, self.col = -1, -1, -1

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag == "meta":
            for kind in ("name", "property"):
                if at.get(kind) in DATE_NAMES and at.get("content"):
                    self.dates.setdefault((DATE_NAMES.index(at[kind]), kind), at["content"])
        if tag == "time":
            rank = len(DATE_NAMES) + ("data-article-date" not in at)
            self.open_time = [(rank, ""), at.get("datetime"), []]
        if tag in SKIPPED:
            self.skip += 1
        if tag == "title":
            self.in_title = True
        if tag in BLOCKS:
            self.text.append("\n")
        if tag == "li":
            self.text.append("\n• ")
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.col = self.row + 1, -1
        elif tag in ("td", "th"):
            self.col += 1
            self.open_cell = [self.table, self.row, self.col, tag == "th", []]
            if self.col:
                self.text.append(" | ")
        elif tag == "a" and at.get("href"):
            self.open_link = [at["href"], []]

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self.text.append("\n")
        if tag == "time" and self.open_time:
            rank, told, parts = self.open_time
            self.dates.setdefault(rank, told or "".join(parts).strip() or None)
            self.open_time = None
        if tag == "a" and self.open_link:
            self.links.append((self.open_link[0], " ".join("".join(self.open_link[1]).split())))
            self.open_link = None
        if tag in ("td", "th") and self.open_cell:
            t, r, c, head, parts = self.open_cell
            self.cells.append((t, r, c, head, " ".join("".join(parts).split())))
            self.open_cell = None

    def handle_data(self, data):
        if self.in_title:
            self.title += data
            return
        if self.open_time:
            self.open_time[-1].append(data)
        if self.open_link:  # links of menus count, their text doesn't
            self.open_link[-1].append(data)
        if not self.skip:
            self.text.append(data)
            if self.open_cell:
                self.open_cell[-1].append(data)


def told_date(page: Page) -> str | None:
    """The page's date: of the strongest meta element, else of the article's time element, else of the first one."""
    return page.dates[min(page.dates)] if page.dates else None


def parse(html: str | None, url: str | None) -> tuple:
    """title, block text, date, (absolute link, text) pairs and table cells; empty for null or empty html."""
    page = Page()
    page.feed(html or "")
    page.close()
    lines = (" ".join(line.split()) for line in "".join(page.text).split("\n"))
    links = []
    for href, text in page.links:
        try:
            links.append((urljoin(url or "", href), text))
        except ValueError:  # no URL
            links.append((href, text))
    return " ".join(page.title.split()), "\n".join(x for x in lines if x), told_date(page), links, page.cells


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, title, text, updated, links and cells of each page."""
    ready(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    link = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))
    cell = pa.list_(pa.struct([("tab", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("head", pa.bool_()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(h.as_py(), u.as_py()) for u, h in zip(batch.column(1), batch.column(2), strict=True)]
            links = [[{"href": a, "text": b} for a, b in r[3]] for r in rows]
            cells = [[dict(zip(("tab", "row", "col", "head", "text"), c, strict=True)) for c in r[4]] for r in rows]
            columns = [batch.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(3)), pa.array(links, link), pa.array(cells, cell)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "title", "text", "updated", "links", "cells"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, {PARSED}")


def links(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    return found.select(id_col, F.inline("links")).withColumnRenamed("text", "label")


def cells(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    return found.select(id_col, F.inline("cells"))


def summary_rows(cells: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Rows of the tables that have a header row: (page, tab, row) and a map from header to text."""
    heads = cells.where("row = 0 and head").select(id_col, "tab", "col", F.lower("text").alias("name"))
    body = cells.where("row > 0").join(heads, [id_col, "tab", "col"])
    entries = F.sort_array(F.collect_list(F.struct("col", "name", "text")))
    named = body.groupBy(id_col, "tab", "row").agg(F.transform(entries, lambda e: F.struct(e["name"], e["text"])).alias("e"))
    return named.select(id_col, "tab", "row", F.map_from_entries(F.transform(F.array_distinct("e.name"), lambda n: F.struct(n, F.filter("e", lambda x: x["name"] == n)[0]["text"]))).alias("fields"))


def sections(text: Column) -> Column:
    """Paragraphs of block text."""
    return F.filter(F.split(text, "\n"), lambda x: x != "")

"""Markdown documents: front matter, tables and plain text as column expressions, sections by one pass over the lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnline.workspace import ready


def front_matter(md: Column) -> Column:
    """struct of meta (map) and body: a leading block between '---' lines, one 'key: value' a line."""
    block = F.regexp_extract(md, r"^---\r?\n((?:.*\r?\n)*?)---\r?\n", 1)
    pairs = F.regexp_extract_all(block, F.lit(r"(?m)^([\w.]+):[ \t]*(.*?)[ \t]*$"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([\w.]+):", 1), F.trim(F.regexp_replace(p, r"^[\w.]+:[ \t]*", ""))))
    firsts = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["col1"]), e["col1"]) == i + 1)
    return F.struct(F.map_from_entries(firsts).alias("meta"), F.regexp_replace(md, r"^---\r?\n(?:.*\r?\n)*?---\r?\n", "").alias("body"))


_FENCE, _HEADING = re.compile(r"\s*```", re.A), re.compile(r"(#{1,6})\s+(?=\S)", re.A)
_MARKS, _ID = re.compile(r"<!--.*?-->|\s#+\s*$", re.A), re.compile(r"<!--\s*(\d+)\s*-->", re.A)
SECTION = "section long, level int, title string, body string, whole string, ends long, ids array<string>"
_TOLD = 4 << 20  # characters of a batch of sections


def sections_of(md: str | None) -> Iterator[tuple]:
    """(section, level, title, body, whole, ends, ids) of the headings of one document, in one pass over its lines.

    A stack holds the headings whose part is not over; a heading ends those of its own level and of deeper ones, so each is
    pushed and popped once. Parts are sliced from the lines when all ends are known.
    """
    lines, heads, ends, open_heads, fenced = re.split(r"\r?\n", md or ""), [], [], [], False
    for i, line in enumerate(lines):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and (mark := _HEADING.match(line)):
            level = len(mark[1])
            while open_heads and heads[open_heads[-1]][1] >= level:
                ends[open_heads.pop()] = len(heads)
            open_heads.append(len(heads))
            heads.append((i, level, line[mark.end() :]))
            ends.append(None)
    for j, (i, level, title) in enumerate(heads):
        until = heads[j + 1][0] if j + 1 < len(heads) else len(lines)
        whole = heads[ends[j]][0] if ends[j] is not None else len(lines)
        body = "\n".join(lines[i + 1 : until]).strip(" ")
        yield j + 1, level, _MARKS.sub("", title).strip(" "), body, body if whole == until else "\n".join(lines[i + 1 : whole]).strip(" "), None if ends[j] is None else ends[j] + 1, _ID.findall(lines[i])


def heading_sections(docs: DataFrame, id_col: str, md_col: str) -> DataFrame:
    """(id, section, level, title, body, whole, ends, ids) of each heading, fences respected; the body goes to the next heading.

    ends is the next section of the same or a higher level (null: the document's end); whole goes up to it, deeper headings
    included; ids are the numbers in comments of the heading. Linear in the lines of a document.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
    names = [part.split()[0] for part in SECTION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = [], [], 0

            def told(batch=batch) -> pa.RecordBatch:
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[id_col, *names])

            for i, md in enumerate(batch.column(1)):
                for row in sections_of(md.as_py()):
                    at.append(i)
                    rows.append(row)
                    size += len(row[4])
                    if size > _TOLD:
                        yield told()
                        at, rows, size = [], [], 0
            if rows:
                yield told()

    return docs.select(id_col, md_col).mapInArrow(run, f"`{id_col}` {kind}, {SECTION}")


def applies_to(md: Column) -> Column:
    """array of the items listed right after a line 'Applies to:', without marks; empty if there is none."""
    block = F.regexp_extract(F.coalesce(md, F.lit("")), r"(?im)^[>\s*]*Applies to:?\**[ \t]*\r?\n((?:[>\s]*[-*+] .*(?:\r?\n|$))+)", 1)
    items = F.transform(F.split(block, r"\r?\n"), lambda x: F.trim(to_text(F.regexp_replace(x, r"^[>\s]*[-*+]\s+", ""))))
    return F.filter(items, lambda x: x != "")


def to_text(md: Column) -> Column:
    """Without link targets, emphasis, code marks, comments and heading signs."""
    for pattern, to in ((r"(?s)<!--.*?-->", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"`([^`]*)`", "$1"), (r"(?m)^\s*[-*]\s+", "• ")):
        md = F.regexp_replace(md, pattern, to)
    return F.trim(md)


def table_rows(text: Column) -> Column:
    """array of arrays of cells: the lines between pipes, separator lines left out."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"\|") & ~x.rlike(r"^\s*\|?[\s:|-]+\|?\s*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def carried(rows: DataFrame, id_col: str, order: str, column: str) -> DataFrame:
    """rows whose column keeps the last value seen above in its document."""
    w = Window.partitionBy(id_col).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))

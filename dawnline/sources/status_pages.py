"""Status pages in HTML: the rows of a summary table, joined to the sections that their links name.

A section runs from an element whose id (or link name) is an issue's anchor to the next such element or heading of the first
two levels, in document order, however the elements are nested. Sections and tables meet by position: a table belongs to the
last section that begins before it, found by a running window over the page, not by comparing tables with sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnline.functions import dates, fixed, labels, text
from dawnline.sources import tree
from dawnline.workspace import stored


def issue_id(anchor: Column, title: Column) -> Column:
    """The digits of an issue's anchor; else its slug; else that of the title."""
    digits = F.regexp_extract(anchor, fixed.ISSUE_ANCHOR, 1)
    return F.when(digits != "", digits).when(anchor.isNotNull(), text.slug(anchor, 40)).otherwise(F.concat(F.lit("t-"), text.slug(title, 60)))


def summary_rows(cells: DataFrame, page: str) -> DataFrame:
    """(page, issue_id, anchor, title, short, status_cell, origin_cell, updated_cell) of the rows of summary tables.

    A summary table has headers that name a summary and a status; a table without header cells has them in its first row. Rows
    of fewer than two cells, or without a title, are none; of rows of one issue the last counts.
    """
    table = Window.partitionBy(page, "tab")
    name = F.lower(text.norm_space("text"))
    heads = F.col("head") | (~F.max("head").over(table) & (F.col("row") == F.min("row").over(table)))
    has = lambda word: F.contains(F.col("name"), F.lit(word))
    kind = F.when(has("summary"), "summary").when(has("originating"), "origin").when(has("status"), "status").when(has("updated") | has("resolved") | has("date"), "updated")
    rows = cells.withColumns({"name": name, "is_head": heads}).withColumn("kind", F.when(F.col("is_head"), kind))
    places = {k: F.max(F.when(F.col("kind") == k, F.col("col"))).over(table).alias(f"at_{k}") for k in ("summary", "origin", "status", "updated")}
    rows = rows.select("*", *places.values(), F.max(F.col("is_head") & has("status")).over(table).alias("stated")).where("at_summary is not null and stated and not is_head and not head")
    of = lambda k, column="text": F.max(F.when(F.col("col") == F.col(f"at_{k}"), F.col(column)))
    told = rows.groupBy(page, "tab", "row").agg(
        F.count("*").alias("cells"), of("summary").alias("full"), of("summary", "lead").alias("lead"), of("summary", "ref").alias("anchor"),
        of("status").alias("status_cell"), of("origin").alias("origin_cell"), of("updated").alias("updated_cell"),
    )
    title = F.coalesce(F.nullif("lead", F.lit("")), text.norm_space(F.substring_index("full", "\n", 1)))
    # the title's first place in the cell is left out of the short text
    at = F.instr(F.col("full"), F.col("title"))
    short = F.when(at > 0, F.concat(F.substring(F.col("full"), F.lit(1), at - 1), F.substring(F.col("full"), at + F.length("title"), F.length("full")))).otherwise(F.col("full"))
    told = told.where("cells >= 2").withColumn("title", title).where("title <> ''").withColumns({"short": text.norm_space(short), "issue_id": issue_id(F.col("anchor"), F.col("title"))})
    columns = ["anchor", "title", "short", "status_cell", "origin_cell", "updated_cell"]
    last = F.max_by(F.struct(*columns), F.struct("tab", "row"))
    return told.groupBy(page, "issue_id").agg(last.alias("x")).select(page, "issue_id", "x.*")


def _sections() -> Column:
    """The sections that begin at anchors, of a page's tree: structs of anchor, node, stop, body."""
    is_anchor = lambda e: F.coalesce(e["ident"].rlike(fixed.ISSUE_ANCHOR), F.lit(False))
    size, pieces = F.size("elements"), F.size("pieces")
    section = lambda e, nexts: F.struct(e["ident"].alias("anchor"), e["node"].alias("node"), F.coalesce(nexts["node"], size).alias("stop"), tree.between(e["at"], F.coalesce(nexts["at"], pieces)).alias("body"))
    own = F.filter(F.transform("_marks", lambda e, i: F.struct(is_anchor(e).alias("is"), e.alias("e"), F.get("_marks", i + 1).alias("next"))), lambda x: x["is"])
    # links to places that don't look like an issue's anchor count, too, where there are any
    others = F.when(F.size("_refs") > 0, tree.numbered(lambda e, i: F.array_contains("_refs", e["ident"]))).otherwise(F.filter("_marks", lambda e: F.lit(False)))
    more = F.transform(others, lambda e: section(e, F.get(F.filter("_marks", lambda m: m["node"] > e["node"]), F.lit(0))))
    return F.concat(F.transform(own, lambda x: section(x["e"], x["next"])), more)


def read(found: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, cells, sections) of trees of pages, as a table: pages are parsed once, and texts are not kept twice."""
    is_mark = lambda e, i: F.coalesce(e["ident"].rlike(fixed.ISSUE_ANCHOR), F.lit(False)) | e["tag"].isin("h1", "h2")
    refs = F.array_distinct(F.transform("cells", lambda c: F.get("elements", c["node"])["ref"]))
    found = found.withColumns({"_marks": tree.numbered(is_mark), "_refs": F.filter(refs, lambda r: ~r.rlike(fixed.ISSUE_ANCHOR))})
    return stored(found.sparkSession, found.select(page, tree.table_cells().alias("cells"), _sections().alias("sections")), "pages")


def sections(pages: DataFrame, page: str) -> DataFrame:
    """(page, issue_id, anchor, node, stop, body) of the sections of issues: the elements from node to before stop."""
    rows = pages.select(page, F.inline("sections"))
    first = Window.partitionBy(page, "anchor").orderBy("node")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1 and body <> ''").withColumn("issue_id", issue_id(F.col("anchor"), F.lit("")))
    last = F.max_by(F.struct("anchor", "node", "stop", "body"), "node")
    return rows.groupBy(page, "issue_id").agg(last.alias("x")).select(page, "issue_id", "x.*")


def section_tables(sections: DataFrame, cells: DataFrame, page: str) -> DataFrame:
    """(page, node, meta_status, meta_origin, meta_history) of the first table in each section: the cells of its first row."""
    table = Window.partitionBy(page, "tab")
    kind = lambda word: F.max(F.when(F.col("head") & F.contains(F.lower("text"), F.lit(word)), F.col("col"))).over(table)
    rows = cells.select(page, "tab", "row", "col", "head", "text", kind("status").alias("at_status"), kind("originating").alias("at_origin"), kind("history").alias("at_history"), F.min(F.when(~F.col("head"), F.col("row"))).over(table).alias("first"))
    of = lambda k: F.max(F.when(~F.col("head") & (F.col("row") == F.col("first")) & (F.col("col") == F.col(f"at_{k}")), F.col("text"))).alias(f"meta_{k}")
    tables = rows.groupBy(page, "tab").agg(*map(of, ("status", "origin", "history")))
    metas = ["meta_status", "meta_origin", "meta_history"]
    points = sections.select(page, "node", F.struct("node", "stop").alias("section"), F.lit(None).cast("struct<meta_status: string, meta_origin: string, meta_history: string>").alias("meta"))
    points = points.unionByName(tables.select(page, F.col("tab").alias("node"), F.lit(None).cast("struct<node: int, stop: int>").alias("section"), F.struct(*metas).alias("meta")))
    order = Window.partitionBy(page).orderBy("node", F.col("section").isNull())
    placed = points.withColumn("section", F.last("section", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.where("meta is not null and node < section.stop").groupBy(page, F.col("section.node").alias("section")).agg(F.min_by("meta", "node").alias("meta"))
    return placed.select(page, F.col("section").alias("node"), "meta.*")


def labelled_part(label: str, body: Column) -> Column:
    """What follows 'label:' up to the next label, spaces collapsed; empty if there is none."""
    stops = "|".join(fixed.PART_LABELS)
    found = F.regexp_extract(body, rf"(?is)(?<![A-Za-z]){label}\s*:\s*(.+?)(?=(?:{stops})\s*:|\z)", 1)
    return F.btrim(text.norm_space(found), F.lit(" ·"))


def affected(body: Column) -> Column:
    """The last block of affected platforms; all of the text if there is none."""
    block = F.regexp_extract(body, r"(?is).*Affected platforms?\s*:(.+?)(?=Workaround\s*:|Resolution\s*:|Next steps\s*:|\z)", 1)
    return F.coalesce(F.nullif(block, F.lit("")), body)


def platforms(block: Column) -> Column:
    """map of client and server to what a block of affected platforms says of them."""

    def of(kind: str) -> Column:
        value = F.btrim(text.norm_space(F.regexp_extract(block, rf"{kind}\s*:\s*(.+)", 1)), F.lit(" ·;"))
        return F.when(~F.lower(value).isin("", "none", "n/a", "-"), F.struct(F.lit(kind.lower()).alias("k"), value.alias("v")))

    return F.map_from_entries(F.array_compact(F.array(of("Client"), of("Server"))))


def issue_fields(rows: DataFrame, page: str) -> DataFrame:
    """The fields of issues from (page, issue_id, anchor, title, body, short, status_cell, origin_cell, meta_status, meta_origin).

    What is looked for in a text is a column of its own before it is read more than once.
    """
    rows = rows.withColumn("_body", F.coalesce("body", F.lit("")))
    body = F.col("_body")
    given = lambda c: F.nullif(c, F.lit(""))
    when = {f"_{k}": F.translate(F.regexp_extract(body, label + fixed.HISTORY_DATE, 1), ",", " ") for k, label in fixed.HISTORY_LABELS.items()}
    rows = rows.withColumns({
        "_stated": F.when(given("status_cell").isNull() & given("meta_status").isNull(), F.regexp_extract(body, fixed.STATED, 1)), "_named": F.when(F.col("meta_origin").isNull(), F.regexp_extract(body, r"(?s)Originating update\s*:(.{0,160})", 1)).otherwise(F.col("meta_origin")),
        "_block": affected(body), "_first": text.norm_space(F.substring_index(body, "\n", 1)), "workaround": text.without_registry_warning(labelled_part("Workaround", body)), "resolution": labelled_part("Resolution", body), "next_steps": labelled_part("Next steps", body), **when,
    })
    origin = F.coalesce("origin_cell", F.lit(""))
    rows = rows.withColumns({
        "_origin": F.when(F.size(text.kbs(origin)) > 0, origin).otherwise(F.col("_named")), "status_raw": text.norm_space(F.coalesce(given("status_cell"), given("meta_status"), "_stated")), "platforms": platforms(F.col("_block")),
        "title": F.coalesce("title", given("_first"), "issue_id"), "detailed": F.col("body").isNotNull(), "body": F.coalesce(given("body"), "short", F.lit("")), "_fixes": text.fix_kbs("resolution"),
    })
    rows = rows.withColumns({"originating_kbs": text.kbs("_origin"), "originating_builds": text.builds("_origin"), "_kbs": text.kbs("status_raw")})
    rows = rows.withColumn("resolving_kbs", F.array_sort(F.array_except(F.array_union("_kbs", "_fixes.full"), "originating_kbs")))
    partial = F.array_except(F.array_except("_fixes.partial", "resolving_kbs"), "originating_kbs")
    symptoms = F.element_at(F.split("body", fixed.AFTER_SYMPTOMS, 2), 1)
    return rows.select(
        page, "issue_id", "anchor", "title", "body", labels.status(F.col("status_raw")).alias("status"), "status_raw", "originating_kbs", "originating_builds", "resolving_kbs", partial.alias("partial_fix_kbs"), "workaround", "resolution", "next_steps", "platforms",
        text.products(F.array_join(F.map_values("platforms"), " ; ")).alias("products"), *[dates.parse_loose(given(f"_{k}")).alias(k) for k in fixed.HISTORY_LABELS], dates.parse_loose(F.col("updated_cell")).alias("updated"), text.symptom_tags(F.concat_ws(" ", "title", symptoms)).alias("tags"),
        F.concat_ws(" ", "title", "body", "status_raw", "resolution").rlike(fixed.ROLLBACK).alias("rollback"), "detailed",
    )


def status_issues(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """The issues of status pages (as read): summary rows with or without a section, and sections without a row.

    Origin updates are those of the summary's cell, else of the section's table, else of its text. Resolving updates are those
    of the status cell and the full fixes of the resolution, without the origin; partial fixes without either. Tags come from
    the symptoms only. A page without summary table and sections gives no rows; structure() tells it from one without issues.
    """
    cells = pages.select(page, F.inline("cells"))
    parts = sections(pages, page)
    told = parts.join(section_tables(parts, cells, page), [page, "node"], "left").withColumnRenamed("anchor", "_anchor")
    joined = summary_rows(cells, page).join(told, [page, "issue_id"], "full_outer").withColumn("anchor", F.coalesce("anchor", "_anchor"))
    return issue_fields(joined, page)


def structure(pages: DataFrame, issues: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, tables, issues, structure_ok) of every page read: whether it has a summary table or an issue."""
    heads = F.filter("cells", lambda c: c["head"] | (c["row"] == 0))
    named = lambda word: F.array_distinct(F.filter(heads, lambda c: F.contains(F.lower(c["text"]), F.lit(word)))["tab"])
    counts = issues.groupBy(page).agg(F.count("*").alias("issues"))
    tables = F.size(F.array_intersect(named("summary"), named("status"))).cast("long")
    out = pages.select(page, tables.alias("tables")).join(counts, page, "left").fillna(0, ["issues"])
    return out.withColumn("structure_ok", F.expr("tables > 0 or issues > 0"))

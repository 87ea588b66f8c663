"""Records from pages: release lists, version tables, contents lists, issue sections, status tables, announcements.

Each is a composition of what the HTML and Markdown sources give (links, cells, sections, carried values) and of text
expressions; windows run by document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnline.functions import dates, fixed, labels, text
from dawnline.sources import markdown, status_pages, tree


def releases(lines: DataFrame, id_col: str, line: str, since: Column) -> DataFrame:
    """(id, date, kb, builds, hotpatch, release_type) of release lines since a date; of each KB the first one."""
    part = lambda i: F.regexp_extract(line, fixed.RELEASE_LINE, i)
    found = lines.where(F.col(line).rlike(fixed.RELEASE_LINE)).select(id_col, F.to_date(dates.parse_loose(part(1))).alias("date"), part(3).alias("kb"), text.builds(part(4)).alias("builds"), (part(2) != "").alias("hotpatch"), F.trim(part(5)).alias("suffix"))
    kept = found.where(F.col("date") >= since)
    once = kept.withColumn("_n", F.row_number().over(Window.partitionBy("kb").orderBy("date", id_col))).where("_n = 1").drop("_n")
    return once.withColumn("release_type", labels.release_type(F.col("suffix"), F.col("hotpatch"), F.col("date")))


def support_rows(docs: DataFrame, id_col: str, md: str, today: Column, gone: int = 120) -> DataFrame:
    """(id, version, support_end, days_left) of the rows of a version table; ended more than gone days ago: left out."""
    rows = docs.select(id_col, F.posexplode(markdown.table_rows(F.col(md))).alias("row", "cells")).where(F.size("cells") >= 3)
    first = F.element_at("cells", 1)
    version = F.coalesce(F.nullif(F.regexp_extract(first, r"\*\*(\d{4})\*\*", 1), F.lit("")), F.nullif(F.regexp_extract(first, r"\b([12]\d{3})\b", 1), F.lit("")))
    end = F.to_date(dates.parse_loose(markdown.to_text(F.element_at("cells", 3))))
    found = rows.where(~F.lower(first).startswith("version")).select(id_col, "row", version.alias("version"), end.alias("support_end")).where("version is not null")
    found = found.withColumn("days_left", F.date_diff("support_end", today)).where(F.col("days_left").isNull() | (F.col("days_left") > -gone))
    order = Window.partitionBy(id_col, "version").orderBy("row")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(id_col, "version", "support_end", "days_left")


def support_tables(trees: DataFrame, id_col: str, today: Column, gone: int = 120) -> DataFrame:
    """As support_rows, of HTML pages: the first table with rows to keep whose first head names versions and another one the support's end."""
    cells = trees.select(id_col, F.inline(tree.table_cells()))
    of_table, low = Window.partitionBy(id_col, "tab"), F.lower(text.norm_space("text"))
    told = lambda found: F.max(F.col("head") & found).over(of_table)
    cells = cells.withColumns({"_versions": told((F.col("col") == 0) & low.contains("version")), "_ends": told(low.contains("support end"))})
    at = lambda i: F.max(F.when(F.col("col") == i, text.norm_space("text")))
    rows = cells.where("_versions and _ends and not head").groupBy(id_col, "tab", "row").agg(at(0).alias("first"), at(2).alias("third"))
    version = F.nullif(F.regexp_extract("first", r"\b(2\d{3})\b", 1), F.lit(""))
    found = rows.where("third is not null").withColumns({"version": version, "support_end": F.to_date(dates.parse_loose(F.col("third")))}).where("version is not null")
    found = found.withColumn("days_left", F.date_diff("support_end", today)).where(F.col("days_left").isNull() | (F.col("days_left") > -gone))
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy(id_col, "version").orderBy("tab", "row"))).withColumn("_tab", F.min("tab").over(Window.partitionBy(id_col)))
    return found.where("_n = 1 and tab = _tab").select(id_col, "version", "support_end", "days_left")


def contents_list(docs: DataFrame, id_col: str, yml: str, since: int = 0) -> DataFrame:
    """(kb, title, versions) of a contents list: names under 'Version nnnn' with a link to a Markdown page after them.

    Updates that stand under versions before since only are left out; of the others all versions are told.
    """
    lines = docs.select(id_col, F.posexplode(F.split(yml, r"\r?\n")).alias("line", "content"))
    name = F.nullif(F.trim(F.regexp_replace(F.regexp_extract("content", fixed.CONTENTS_NAME, 1), r"^\s*['\"]|['\"]\s*$", "")), F.lit(""))
    linked = F.col("content").rlike(fixed.CONTENTS_LINK)
    marked = lines.withColumns({"name": name, "version": F.nullif(F.regexp_extract(name, fixed.CONTENTS_VERSION, 1), F.lit("")), "linked": linked})
    before = Window.partitionBy(id_col).orderBy("line")
    marked = markdown.carried(marked, id_col, "line", "version").withColumn("title", F.lag("name").over(before))
    rows = marked.where("linked and title is not null").withColumn("kb", F.nullif(F.regexp_extract("title", r"KB\s?(\d{6,9})", 1), F.lit("")))
    return _listed(rows.select(id_col, F.col("line").alias("at"), "kb", "title", "version"), id_col, since)


def contents_pages(trees: DataFrame, id_col: str, since: int = 0) -> DataFrame:
    """As contents_list, of HTML pages: links that name an update, each under the last heading (level 2 or 3) that names a version."""
    kept = tree.numbered(lambda e, i: e["tag"].isin("h2", "h3", "a") & tree.in_root(i))
    told = F.transform(kept, lambda e: F.struct(e["node"].alias("at"), e["tag"].alias("tag"), e["href"].alias("href"), text.norm_space(tree.text_of(e["node"])).alias("title")))
    rows = trees.select(id_col, F.inline(told))
    number = F.when(F.col("tag") != "a", F.nullif(F.regexp_extract("title", r"\b(2\d{3})\b", 1), F.lit("")))
    rows = markdown.carried(rows.withColumn("version", number), id_col, "at", "version")
    rows = rows.where("tag = 'a' and href <> ''").withColumn("kb", F.nullif(F.regexp_extract("title", r"KB\s?(\d{6,9})", 1), F.lit("")))
    return _listed(rows, id_col, since)


def _listed(rows: DataFrame, id_col: str, since: int) -> DataFrame:
    """(kb, title, versions) of rows (id, at, kb, title, version): the first title, all versions, if the last one is since or later."""
    titles = F.min_by("title", F.struct(id_col, "at"))
    found = rows.where("kb is not null").groupBy("kb").agg(titles.alias("title"), F.sort_array(F.collect_set("version")).alias("versions"))
    return found.where((F.size("versions") == 0) | (F.array_max("versions").cast("int") >= since))


def first_version(today: Column, years: int = 2) -> Column:
    """The number that the versions of the year so many years ago begin with, as '2400'."""
    return F.date_format(F.add_months(today, -12 * years), "yy'00'").cast("int")


def hotfix_details(docs: DataFrame, id_col: str, md: str, issues: int = 40) -> DataFrame:
    """(id, date, fixed_issues, summary, text) of hotfix pages in Markdown, one row a page.

    fixed_issues are the first bold items in lists of the parts (level 2) whose title tells of fixes, in page order; the
    summary is the last part that begins so, cut at 1,500 characters, text the whole page, cut at 8,000. Null or empty pages
    and pages without such parts have an empty list and an empty summary; id_col names a page.
    """
    pages = docs.select(F.col(id_col).alias("_page"), markdown.front_matter(F.coalesce(F.col(md), F.lit(""))).alias("_parts"))
    pages = pages.select("_page", F.to_date(dates.parse_loose(F.col("_parts.meta")["ms.date"])).alias("date"), F.col("_parts.body").alias("_body"))
    parts = markdown.heading_sections(pages, "_page", "_body").where("level = 2")
    told, low = F.struct("section", "body"), F.lower("title")
    fixes = F.array_sort(F.collect_list(F.when(low.contains("fixed"), told)))
    lists = parts.groupBy(F.col("_page").alias("_of")).agg(fixes.alias("_fixes"), F.max_by("body", F.when(low.startswith("summary"), F.col("section"))).alias("_summary"))
    items = F.flatten(F.transform("_fixes", lambda p: F.regexp_extract_all(p["body"], F.lit(fixed.FIXED_ISSUE), F.lit(1))))
    names = F.transform(F.slice(items, 1, issues), text.norm_space)
    summary = F.substring(markdown.to_text(F.coalesce(F.col("_summary"), F.lit(""))), 1, 1500)
    found = pages.join(lists, F.expr("_page <=> _of"), "left")
    return found.select(F.col("_page").alias(id_col), "date", F.coalesce(names, F.array().cast("array<string>")).alias("fixed_issues"), summary.alias("summary"), F.substring(markdown.to_text(F.col("_body")), 1, 8000).alias("text"))


def preview_notes(docs: DataFrame, id_col: str, md: str, versions: int = 3) -> DataFrame:
    """(id, version, published, body) of the first versions of each page of preview notes.

    A version is a heading of level 3 with its number, of year and month; published is the first day of that month, null for
    a month that is none; the body has what is below, deeper headings included, cut at 5,000 characters.
    """
    pages = docs.select(id_col, markdown.front_matter(F.coalesce(F.col(md), F.lit("")))["body"].alias("_body"))
    number = F.regexp_extract("title", fixed.PREVIEW_VERSION, 1)
    rows = markdown.heading_sections(pages, id_col, "_body").where("level = 3").withColumn("version", number).where("version <> ''")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy("section"))).where(F.col("_n") <= versions)
    published = F.to_date(F.try_to_timestamp(F.concat(F.lit("20"), F.col("version"), F.lit("01")), F.lit("yyyyMMdd")))
    return first.select(id_col, "version", published.alias("published"), F.substring(markdown.to_text(F.col("whole")), 1, 5000).alias("body"))




def feature_sections(docs: DataFrame, id_col: str, md: str, weeks: int = 6) -> DataFrame:
    """Features (level 4) of a page of news by week (level 2) and category (level 3), of its first weeks.

    (id, title, category, week, service, work_items, stage, change_kind, platforms, licence, rollout, admin_action, tags).
    """
    rows = markdown.heading_sections(docs, id_col, md)
    order = Window.partitionBy(id_col).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("level") == 2, F.struct("section", "title")), ignorenulls=True).over(order)
    below = F.last(F.when(F.col("level") <= 3, F.struct("level", "title")), ignorenulls=True).over(order)
    is_week = (F.col("level") == 2) & F.col("title").rlike(fixed.WEEK)
    rows = rows.withColumns({"_top": top, "_below": below, "_weeks": F.sum(is_week.cast("int")).over(order)})
    week = F.nullif(F.regexp_extract("_top.title", fixed.WEEK, 1), F.lit(""))
    found = rows.where((F.col("level") == 4) & week.isNotNull() & (F.col("_weeks") <= weeks))
    body, named = markdown.to_text(F.col("whole")), F.lower(F.array_join(markdown.applies_to(F.col("whole")), " "))
    return found.select(
        id_col, "title", F.when(F.col("_below.level") == 3, F.col("_below.title")).otherwise("").alias("category"), week.alias("week"), F.nullif(F.regexp_extract("_top.title", fixed.WEEK, 2), F.lit("")).alias("service"), F.col("ids").alias("work_items"),
        labels.stage(F.col("title"), body).alias("stage"), labels.change_kind(F.col("title"), body).alias("change_kind"), labels.platforms(F.coalesce(F.nullif(named, F.lit("")), body)).alias("platforms"),
        labels.licence_note(body).alias("licence"), labels.rollout_note(body).alias("rollout"), labels.admin_action(F.col("whole")).alias("admin_action"), text.symptom_tags(F.concat_ws(" ", "title", body)).alias("tags"),
    )


def issue_sections(sections: DataFrame, id_col: str, known: str = "known issues") -> DataFrame:
    """(id, title, tags, full and partial fixes, versions) of the sections below a heading that names known issues."""
    order = Window.partitionBy(id_col).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("level") <= 2, F.lower("title")), ignorenulls=True).over(order)
    rows = sections.withColumn("_top", top).where(F.contains("_top", F.lit(known)) & (F.col("level") > 2))
    whole = F.concat_ws(" ", "title", "body")
    applies = F.regexp_extract(markdown.to_text(F.col("body")), fixed.APPLIES_TO_VERSIONS, 1)
    fixes = text.fix_kbs("body")
    return rows.select(id_col, "section", "title", text.symptom_tags(whole).alias("tags"), fixes["full"].alias("fix_kbs"), fixes["partial"].alias("partial_fix_kbs"), F.regexp_extract_all(applies, F.lit(r"\d{4}"), F.lit(0)).alias("versions"))


def status_issues(rows: DataFrame, details: DataFrame, page: str) -> DataFrame:
    """Summary rows (page, anchor, title, status, kb) with their detail sections (page, anchor, body), where both are tables already; structure_ok tells if one was found."""
    joined = rows.join(details, [page, "anchor"], "left")
    empty = [F.lit(None).cast("string").alias(c) for c in ("short", "meta_status", "meta_origin", "updated_cell")]
    joined = joined.select(page, F.col("anchor").alias("issue_id"), "anchor", "title", "body", F.col("status").alias("status_cell"), F.col("kb").alias("origin_cell"), *empty)
    found = status_pages.issue_fields(joined, page)
    return found.select(page, "anchor", "title", "status", "originating_kbs", "resolving_kbs", "partial_fix_kbs", F.nullif("workaround", F.lit("")).alias("workaround"), "tags", "rollback", F.col("detailed").alias("structure_ok"))


def announcements(cells: DataFrame, page: str) -> DataFrame:
    """(page, date, title) of the rows of two-column tables that begin with a text and end with a date."""
    rows = cells.where("row > 0").groupBy(page, "tab", "row").agg(F.max(F.when(F.col("col") == 0, F.col("text"))).alias("title"), F.max(F.when(F.col("col") == 1, F.col("text"))).alias("at"))
    return rows.select(page, "title", dates.parse_loose(F.col("at")).alias("at")).where("at is not null and title <> ''")


def summary_text(kind: Column, title: Column, body: Column, tags: Column, fixes: Column) -> Column:
    """A plain summary by rule: the first sentences, what it touches, and the updates that fix it."""
    touches = F.when(F.size(tags) > 0, F.concat(F.lit("Touches: "), F.array_join(tags, ", "), F.lit(".")))
    fixed_by = F.when((kind == "issue") & (F.size(fixes) > 0), F.concat(F.lit("Fixed by KB"), F.array_join(fixes, ", KB"), F.lit(".")))
    return F.concat_ws(" ", F.coalesce(F.nullif(text.first_sentences(body), F.lit("")), title), touches, fixed_by)

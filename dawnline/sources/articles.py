"""Known issues of articles in HTML: the section below a heading that names known issues, read by the first layout that fits.

Layouts, in order: details blocks, whose parts follow labels; tables with a column of symptoms; sub-headings or bold lines;
the whole section as one issue. Each gives candidates with its rank, and of a page those of the smallest rank stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnline.functions import fixed, text
from dawnline.sources import tree
from dawnline.workspace import stored

PARTS = ["symptoms", "workaround", "resolution", "next_steps"]
LAYOUTS = ["details", "table", "headings", "whole"]


def known_issues(found: DataFrame) -> DataFrame:
    """The trees of pages that have such a section, with known (heading, nodes, first, stop, text), without those that say there is no issue.

    nodes are the elements beside the heading, up to the next heading of its level or a higher one (of the first two levels,
    or the third for a heading of that level); first and stop bound the numbers of all elements in it.
    """
    heads = tree.numbered(lambda e, i: e["tag"].isin("h2", "h3") & tree.in_root(i) & F.coalesce(tree.text_of(i).rlike("(?i)known issues"), F.lit(False)))
    rows = found.withColumn("_h", F.get(heads, F.lit(0))).where("_h is not null")
    h = F.col("_h")
    rows = rows.withColumn("_beside", tree.numbered(lambda e, i: (e["parent"] == h["parent"]) & (i > h["node"])))
    ends = lambda e: e["tag"].isin("h1", "h2") | ((e["tag"] == "h3") & (h["tag"] == "h3"))
    rows = rows.withColumn("_stop", F.get(F.filter("_beside", ends), F.lit(0)))
    parent = tree.element(h["parent"])
    stop = F.coalesce(F.col("_stop.node"), parent["last"] + 1, F.size("elements"))
    told = tree.between(h["end"], F.coalesce(F.col("_stop.at"), parent["end"], F.size("pieces")))
    known = F.struct(h.alias("heading"), F.filter("_beside", lambda e: e["node"] < stop).alias("nodes"), (h["last"] + 1).alias("first"), stop.alias("stop"), told.alias("text"))
    rows = rows.withColumn("known", known).drop("_h", "_beside", "_stop")
    return rows.where(~(F.col("known.text").rlike(fixed.NO_ISSUES) & (F.length("known.text") < 400)))


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(text.norm_space(c), ":+$", ""))


def _part(tag: Column, told: Column, bold: Column) -> Column:
    """The part that an element is the label of: a heading, or a paragraph whose bold text is all that it says; else null."""
    labels = F.create_map(*(F.lit(x) for pair in fixed.PART_OF.items() for x in pair))
    is_label = tag.isin("h3", "h4", "h5", "h6") | ((tag == "p") & (_plain(bold) == _plain(told)))
    return F.when(is_label, F.try_element_at(labels, _plain(told)))


def _told(e: Column) -> Column:
    """What grammars need of an element: its parent's number and its own, tag and texts."""
    return F.struct(e["parent"].alias("parent"), e["node"].alias("node"), e["tag"].alias("tag"), tree.text_of(e["node"]).alias("text"), tree.text_of(e["bold"]).alias("bold"))


def read(found: DataFrame, page: str = "page_id", kb: str = "kb") -> DataFrame:
    """(page, kb, anchor, text, beside, inside, cells) of the known issues of trees of articles, as a table: one parse for all layouts.

    beside are the elements next to the heading, inside the children of details blocks, cells those of tables.
    A block inside of another one that stands beside the heading is none of its own.
    """
    known = F.col("known")
    outer = lambda e: F.exists(known["nodes"], lambda n: (n["tag"] == "details") & (n["node"] < e["node"]) & (e["node"] <= n["last"]))
    within = lambda n: (n >= known["first"]) & (n < known["stop"])
    rows = known_issues(found)
    blocks = tree.numbered(lambda e, i: (e["tag"] == "details") & within(i))
    rows = rows.withColumn("_blocks", F.filter(blocks, lambda e: (e["parent"] == known["heading"]["parent"]) | ~outer(e))["node"])
    inside = F.filter(tree.numbered(lambda e, i: within(i)), lambda e: F.array_contains("_blocks", e["parent"]))
    rows = rows.select(
        page, F.col(kb).alias("kb"), F.coalesce("known.heading.ident", F.lit("known-issues")).alias("anchor"), "known.text", F.transform("known.nodes", _told).alias("beside"),
        F.transform(inside, _told).alias("inside"), tree.table_cells(lambda c: within(c["tab"])).alias("cells"),
    )
    return stored(found.sparkSession, rows, "articles")


def _joined(condition: Column) -> Column:
    """The texts of a group's elements that fulfil a condition, in order, one a line."""
    entries = F.array_sort(F.collect_list(F.when(condition & (F.col("text") != ""), F.struct("node", "text"))))
    return F.array_join(entries["text"], "\n")


def details_issues(rows: DataFrame, page: str) -> DataFrame:
    """The details blocks: the summary is the title, labels begin parts."""
    each = rows.select(page, F.inline("inside"))
    order = Window.partitionBy(page, "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    is_title = (F.col("tag") == "summary") & (F.sum((F.col("tag") == "summary").cast("int")).over(order) == 1)
    each = each.withColumns({"is_title": is_title, "label": _part(F.col("tag"), F.col("text"), F.col("bold"))})
    each = each.withColumn("part", F.coalesce(F.last("label", ignorenulls=True).over(order), F.lit("symptoms")))
    content = ~F.col("is_title") & F.col("label").isNull()
    parts = [_joined(content & (F.col("part") == p)).alias(p) for p in PARTS]
    out = each.groupBy(page, F.col("parent").alias("place")).agg(text.norm_space(F.max(F.when(F.col("is_title"), F.col("text")))).alias("title"), *parts)
    return out.where("title <> ''").select(page, F.lit(0).alias("layout"), F.struct("place", F.lit(0).alias("row")).alias("place"), "title", *PARTS)


def table_issues(rows: DataFrame, page: str) -> DataFrame:
    """The rows of tables with header cells: symptoms (or the first column), workaround or resolution; the title is what is bold, or the first sentence."""
    cells = rows.select(page, F.inline("cells"))
    table = Window.partitionBy(page, "tab")
    place = lambda pattern: F.min(F.when(F.col("head") & F.lower("text").rlike(pattern), F.col("col"))).over(table)
    cells = cells.select("*", F.coalesce(place("symptom"), F.lit(0)).alias("at_s"), place("workaround|resolution").alias("at_w"), F.max("head").over(table).alias("headed")).where("headed and not head")
    of = lambda at, column: F.coalesce(F.max(F.when(F.col("col") == F.col(at), F.col(column))), F.lit(""))
    out = cells.groupBy(page, "tab", "row").agg(of("at_s", "text").alias("symptoms"), of("at_w", "text").alias("workaround"), of("at_s", "bold").alias("bold"))
    title = F.coalesce(F.nullif("bold", F.lit("")), F.substring_index("symptoms", ".", 1))
    return out.select(page, F.lit(1).alias("layout"), F.struct(F.col("tab").alias("place"), "row").alias("place"), text.norm_space(title).alias("title"), "symptoms", "workaround", F.lit("").alias("resolution"), F.lit("").alias("next_steps"))


def heading_issues(rows: DataFrame, page: str) -> DataFrame:
    """Sub-headings, or paragraphs that are bold as a whole, with what follows them; labels of parts are content."""
    each = rows.select(page, F.inline("beside"))
    bold = (F.col("tag") == "p") & F.col("bold").isNotNull() & (text.norm_space("bold") == text.norm_space("text"))
    is_head = (F.col("tag").isin("h3", "h4", "h5") | bold) & _part(F.col("tag"), F.col("text"), F.col("bold")).isNull()
    order = Window.partitionBy(page).orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("is_head", is_head).withColumn("place", F.sum(F.col("is_head").cast("int")).over(order)).where("place > 0")
    out = each.groupBy(page, "place").agg(text.norm_space(F.max(F.when(F.col("is_head"), F.col("text")))).alias("title"), _joined(~F.col("is_head")).alias("symptoms"))
    rest = [F.lit("").alias(p) for p in PARTS[1:]]
    return out.where("title <> '' and symptoms <> ''").select(page, F.lit(2).alias("layout"), F.struct(F.col("place").cast("int").alias("place"), F.lit(0).alias("row")).alias("place"), "title", "symptoms", *rest)


def whole_issue(rows: DataFrame, page: str) -> DataFrame:
    """The whole section as one issue."""
    title = F.concat(F.lit("KB"), F.coalesce("kb", F.lit("")), F.lit(f" {fixed.UNNAMED_ISSUE}"))
    rest = [F.lit("").alias(p) for p in PARTS[1:]]
    return rows.where("text <> ''").select(page, F.lit(3).alias("layout"), F.struct(F.lit(0).alias("place"), F.lit(0).alias("row")).alias("place"), title.alias("title"), F.col("text").alias("symptoms"), *rest)


def article_issues(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """The known issues of articles (as read): one row each, with layout, place and fields.

    The origin is what the symptoms name, else the article's KB. A resolution (else the symptoms) with a sentence that says it
    is fixed, and not partly, resolves the issue by the KBs it names; partial fixes mitigate it. No section: no rows.
    """
    every = reduce(DataFrame.unionByName, [details_issues(rows, page), table_issues(rows, page), heading_issues(rows, page), whole_issue(rows, page)])
    every = every.withColumn("_first", F.min("layout").over(Window.partitionBy(page))).where("layout = _first").drop("_first")
    heads = rows.select(page, "kb", "anchor")
    labelled = lambda label: text.norm_space(F.regexp_extract("symptoms", rf"(?is)(?<![A-Za-z])(?:{label})\s*:\s*(.+)", 1))
    own_work, own_fix = text.without_registry_warning("workaround"), F.concat_ws("\n", F.nullif("resolution", F.lit("")), F.nullif("next_steps", F.lit("")))
    told = every.join(heads, page).withColumns({"_w": own_work, "_r": own_fix})
    bare = (F.col("_w") == "") & (F.col("_r") == "")
    told = told.withColumns({"workaround": F.when(bare, labelled("Workaround|Mitigation")).otherwise(F.col("_w")), "resolution": F.when(bare, labelled("Resolution")).otherwise(F.col("_r"))})
    named = text.kbs("symptoms")
    told = told.withColumns({"originating_kbs": F.when(F.size(named) > 0, named).otherwise(F.array("kb")), "_fix": F.coalesce(F.nullif("resolution", F.lit("")), "symptoms")})
    fixes = text.fix_kbs("_fix")
    wholly = F.exists(text.sentences("_fix"), lambda s: s.rlike(fixed.WHOLLY_FIXED) & ~s.rlike(fixed.PARTIAL_FIX))
    told = told.withColumns({"_full": F.array_except(fixes["full"], "originating_kbs"), "_partial": F.array_except(fixes["partial"], "originating_kbs"), "_wholly": wholly})
    told = told.withColumn("resolving_kbs", F.when(F.col("_wholly"), F.col("_full")).otherwise(F.array().cast("array<string>")))
    told = told.withColumn("partial_fix_kbs", F.array_except("_partial", "resolving_kbs"))
    status = F.when(F.col("_wholly"), "resolved").when(F.size("partial_fix_kbs") > 0, "mitigated").otherwise("confirmed")
    part = lambda name, label: F.when(F.col(name) != "", F.concat(F.lit(f"\n\n{label}: "), F.col(name))).otherwise("")
    told = told.withColumns({"status": status, "body": F.concat("symptoms", part("workaround", "Workaround"), part("resolution", "Resolution"))})
    return told.select(
        page, "kb", "anchor", F.element_at(F.array(*map(F.lit, LAYOUTS)), F.col("layout") + 1).alias("layout"), "place", "title", "body", "status", "originating_kbs", "resolving_kbs", "partial_fix_kbs",
        text.norm_space("workaround").alias("workaround"), text.norm_space("resolution").alias("resolution"), text.products("body").alias("products"), text.symptom_tags(F.concat_ws(" ", "title", "symptoms")).alias("tags"),
        F.contains(F.lower("body"), F.lit("known issue rollback")).alias("rollback"),
    )

"""What a reader gets: sources, relevance, sections, alerts, composition; tables kept up to date and pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnline.functions import fixed, urls


def chosen_sources(sources: DataFrame, modules: list[str], tracked: list[str], critical_only: bool = False) -> DataFrame:
    """Enabled sources of switched-on modules; community sources need a tracked module.

    With an adapter column they come in the order of dependency: what others read comes first, then by source.
    """
    module = F.col("module")
    on = module.isin(modules) & ((module != "community") | F.lit(any(m in modules for m in tracked)))
    rows = sources.where(F.col("enabled") & on)
    rows = rows.where("critical") if critical_only else rows
    return rows.orderBy(dependency(F.col("adapter")), "source") if "adapter" in sources.columns else rows


def dependency(adapter: Column) -> Column:
    """The place of a source's adapter among those that depend on each other."""
    table = F.create_map(*(F.lit(x) for pair in fixed.ADAPTER_ORDER.items() for x in pair))
    return F.coalesce(F.try_element_at(table, adapter), F.lit(9))


def critical_view(events: DataFrame, since: Column) -> DataFrame:
    """All risky events, critical ones first, then the newest, with relevant and recent (something has happened to it since then); a reader is shown those that are both."""
    relevant, recent = F.col("relevance") > 0, F.coalesce("changed_at", "first_seen") >= since
    rows = events.where(F.col("risk").isin("high", "critical"))
    rows = rows.withColumns({"relevant": F.coalesce(relevant, F.lit(False)), "recent": F.coalesce(recent, F.lit(False))})
    return rows.orderBy(F.when(F.col("risk") == "critical", 0).otherwise(1), F.desc("changed_at"), "event")


def followed_view(events: DataFrame, top: int = 50) -> DataFrame:
    """Followed events, the newest first."""
    return events.where("followed").orderBy(F.desc("changed_at"), "event").limit(top)


def open_risk_view(events: DataFrame, top: int = 50) -> DataFrame:
    """Open, risky, relevant issues that are neither followed nor muted; a null status is not open."""
    rows = events.where((F.col("kind") == "issue") & ~F.col("status").isin(fixed.RESOLVED) & F.col("risk").isin("high", "critical") & (F.col("relevance") > 0))
    rows = rows.where(~F.coalesce("followed", F.lit(False)) & F.col("muted_at").isNull())
    return rows.orderBy(F.when(F.col("risk") == "critical", 0).otherwise(1), F.desc("changed_at"), "event").limit(top)


def relevant(module: Column, score: Column, followed: Column, has_products: bool) -> Column:
    """Whether an item concerns the reader: never below -10; news and followed items always; others by their score."""
    plain = F.lit(has_products) & (module == "windows")
    by_score = F.when(plain, score > 0).otherwise((score > 0) | module.isin("intune", "configmgr"))
    return F.when(score < -10, False).when(module.isin("news", "content") | followed, True).otherwise(F.coalesce(by_score, F.lit(False)))


def section(module: Column, kind: Column, evidence: Column, category: Column) -> Column:
    field = (kind == "issue") & (evidence == "field")
    return (
        F.when(module == "news", F.concat(F.lit("news_"), F.coalesce(category, F.lit("general")))).when(module == "content", "content")
        .when(field, "field").when(module.isin("windows", "intune", "configmgr"), module).otherwise("windows")
    )


def critical_for_reader(followed: Column, kind: Column, status: Column, risk: Column, score: Column, evidence: Column) -> Column:
    """Open issues that are followed, and risky ones of some relevance that are more than reports; a null status is not open."""
    own = followed & (kind == "issue") & ~status.isin("resolved", "resolved_external")
    risky = risk.isin("high", "critical") & (score >= 1.5) & ~((kind == "issue") & (evidence == "field"))
    return F.coalesce(own, F.lit(False)) | F.coalesce(risky, F.lit(False))


def references(evidence: DataFrame, event: str, trust: str, order: str, url: str, top: int = 8) -> DataFrame:
    """Each event's distinct safe links, official ones first, at most top; picked before they are gathered."""
    rank = F.when(F.col(trust) == "official", 0).when(F.col(trust) == "press", 1).otherwise(2)
    once = evidence.where(F.coalesce(urls.is_safe(F.col(url)), F.lit(False))).groupBy(event, url).agg(F.min(F.struct(rank.alias("r"), F.col(order).alias("o"))).alias("_k"))
    few = once.withColumn("_n", F.row_number().over(Window.partitionBy(event).orderBy("_k", url))).where(F.col("_n") <= top)
    return few.groupBy(event).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", url))), lambda x: x[url]).alias("links"))


def composed(baseline: DataFrame, selected: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Baseline rows that are not selected anyway, then the selected ones, with their position; few rows by their caps."""
    rows = baseline.join(selected.select(key), key, "left_anti").unionByName(selected)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)


def of_partition(rows: DataFrame, demo: bool, column: str = "is_demo") -> DataFrame:
    """The real rows, or those of the demonstration; the two never meet. A filter on the column by which tables are partitioned."""
    return rows.where(F.coalesce(column, F.lit(False)) == F.lit(demo))


def with_products_on(sources: DataFrame, own: list[str], products: str = "product_ids") -> DataFrame:
    """sources with enabled: those that name products are on if one of them is chosen, the others as they were."""
    named = F.size(F.coalesce(products, F.array().cast("array<string>"))) > 0
    chosen = F.arrays_overlap(products, F.array(*map(F.lit, own))) if own else F.lit(False)
    return sources.withColumn("enabled", F.when(named, F.coalesce(chosen, F.lit(False))).otherwise(F.col("enabled")))


def module_on(module: Column, kind: Column, evidence: Column, modules: list[str]) -> Column:
    """Whether an item's module is switched on; reports from the field need the community module, too."""
    field = (kind == "issue") & (evidence == "field")
    return module.isin(modules) & (~field | F.lit("community" in modules))


def alerts(candidates: DataFrame, event: str, order: list[Column], threshold: Column, quiet: Column, exempt: Column, excluded: DataFrame | None = None) -> DataFrame:
    """The newest candidate of each event, if it is over the threshold, with deferred: in quiet hours and not exempt.

    excluded: events (by event) that have been alerted or muted.
    """
    newest = candidates.withColumn("_n", F.row_number().over(Window.partitionBy(event).orderBy(*order))).where("_n = 1").drop("_n")
    over = newest.where(threshold)
    if excluded is not None:
        over = over.join(excluded.select(event), event, "left_anti")
    return over.withColumn("deferred", F.coalesce(quiet & ~exempt, F.lit(False)))


def retained(rows: DataFrame, at: str, since: Column, referenced: DataFrame, key: str) -> DataFrame:
    """Rows to keep: those since a time, and older ones that something refers to."""
    old = rows.where(F.col(at) < since)
    return rows.where(F.col(at) >= since).union(old.join(referenced.select(key), key, "left_semi").select(*rows.columns))


def carried_forward(listed: DataFrame, known: DataFrame, key: str, detail: str, order: Column, first: int) -> DataFrame:
    """listed with known details; of rows still without, the first ones in order are queued."""
    rows = listed.join(known.select(key, detail), key, "left").withColumn("missing", F.col(detail).isNull())
    # the first few by a take-ordered plan, so that no window sees all missing rows
    few = rows.where("missing").orderBy(order).limit(first).select(key, F.lit(True).alias("queued"))
    return rows.join(F.broadcast(few), key, "left").withColumn("queued", F.coalesce("queued", F.lit(False)))

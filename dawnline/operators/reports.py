"""Reports over checks, runs, usage, deliveries and events: plain aggregates, and short lists picked before they are gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_health(checks: DataFrame, source: str, status: str, at: str, check_id: str, failed: str = "error") -> DataFrame:
    """source, last_ok, last_status, last_error (the check's id), checks and errors, in one aggregate over the check log."""
    newest, bad = F.struct(at, check_id), F.col(status) == failed
    return checks.groupBy(F.col(source).alias("source")).agg(
        F.max(F.when(~bad, F.col(at))).alias("last_ok"), F.max_by(status, newest).alias("last_status"), F.max_by(check_id, F.when(bad, newest)).alias("last_error"), F.count("*").alias("checks"), F.count_if(bad).alias("errors"),
    )


def _states(sources: DataFrame, health: DataFrame, failed: str) -> DataFrame:
    """Every enabled source with its health and its state: never, failing, or null."""
    state = F.when(F.col("checks").isNull(), "never").when(F.col("last_status") == failed, "failing")
    return sources.select("source").distinct().join(health, "source", "left").withColumn("state", state)


def coverage(sources: DataFrame, health: DataFrame, since: Column, failed: str = "error") -> DataFrame:
    """How many sources are enabled, ok (checked well since then), failing and never checked; sources: the enabled ones, by source.

    These counts are told with each source, state, last_status and last_ok that is failing or was never checked, and once without a source if there is none.
    """
    rows = _states(sources, health, failed)
    never, failing = F.col("checks").isNull(), F.col("last_status") == failed
    counts = rows.agg(F.count("*").alias("enabled"), F.count_if(~never & ~failing & (F.col("last_ok") >= since)).alias("ok"), F.count_if(failing).alias("failing"), F.count_if(never).alias("never"))
    listed = rows.where("state is not null").select("source", "state", "last_status", "last_ok")
    told = listed.join(F.broadcast(counts), F.lit(True), "right")  # the counts are one row
    return told.select(*counts.columns, *listed.columns)


def unhealthy(sources: DataFrame, health: DataFrame, failed: str = "error") -> DataFrame:
    """source, state (failing or never), last_ok and last_error of every enabled source that is not well."""
    return _states(sources, health, failed).where("state is not null").select("source", "state", "last_ok", "last_error")


def run_report(results: DataFrame, status: str, changed: Column, amount: str) -> DataFrame:
    return results.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"), F.count_if(changed).alias("changed"), F.round(F.sum(amount), 4).alias("total"))


def usage(calls: DataFrame, day: Column, kind: str, units: str, failed: Column, price: float, budget: float) -> DataFrame:
    """Calls, units, cost, errors and what a budget has left, by day and kind."""
    cost = F.sum(units) * price
    return calls.groupBy(day.alias("day"), F.col(kind).alias("kind")).agg(
        F.count("*").alias("calls"), F.round(F.sum(units), 4).alias("units"), F.round(cost, 2).alias("cost"), F.count_if(failed).alias("errors"), F.round(F.greatest(F.lit(budget) - cost, F.lit(0.0)), 2).alias("budget_left"),
    )


def delivery_status(parts: DataFrame, delivery: str, part: Column) -> DataFrame:
    """The status of each delivery from its parts' (sent, pending, uncertain, failed): all sent, any pending, any uncertain, some sent, failed; and counts."""
    has = lambda name: F.coalesce(F.bool_or(part == name), F.lit(False))
    status = F.when(F.bool_and(part == "sent"), "sent").when(has("pending"), "pending").when(has("uncertain"), "uncertain").when(has("sent"), "partial").otherwise("failed")
    return parts.groupBy(F.col(delivery).alias("delivery")).agg(status.alias("status"), F.count("*").alias("parts"), F.count_if(part == "sent").alias("done"))


def open_risks(events: DataFrame, open_risky: Column, order: list[Column], key: str, top: int = 5) -> DataFrame:
    """One row: how many events are open and risky, and the first ones of them."""
    rows = events.where(open_risky)
    first = rows.orderBy(*order).limit(top).agg(F.sort_array(F.collect_list(key)).alias("top"))
    return rows.agg(F.count("*").alias("open_count")).join(F.broadcast(first), F.lit(True))  # one row each


def sources_of(rows: DataFrame, event: str, source: str) -> DataFrame:
    return rows.groupBy(event).agg(F.count_distinct(source).alias("sources"), F.sort_array(F.collect_set(source)).alias("source_list"))


def repeated(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.groupBy(value.alias(name)).agg(F.count("*").alias("n")).where("n > 1")


def counts_of(rows: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """How many rows of each key, and how many meet each condition."""
    return rows.groupBy(key).agg(*(F.count_if(c).alias(name) for name, c in conditions.items()), F.count("*").alias("rows"))


def validation(items: DataFrame, source: str, order: str, title: str, samples: int = 3, chars: int = 40) -> DataFrame:
    """Items, items without a title and the first titles of each source; the samples are picked before they are gathered."""
    counts = items.groupBy(source).agg(F.count("*").alias("items"), F.count_if(F.col(title) == "").alias("warnings"))
    few = items.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(order))).where(F.col("_n") <= samples)
    told = few.groupBy(source).agg(F.sort_array(F.collect_list(F.struct(order, F.substring(title, 1, chars).alias("t")))).alias("_s"))
    return counts.join(told, source).select(source, "items", "warnings", F.col("_s.t").alias("samples"))


def event_rollup(evidence: DataFrame, event: str, at: str, kb: str, source: str, risk: str) -> DataFrame:
    """First and last time, updates, number of sources and highest risk of each event."""
    return evidence.groupBy(event).agg(
        F.min(at).alias("first_seen"), F.max(at).alias("updated"), F.sort_array(F.collect_set(kb)).alias("kbs"), F.count_distinct(source).alias("field_sources"), F.max(risk).alias("risk"),
    )


def newest_of(snapshots: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    return snapshots.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(name))


def recent_targets(records: DataFrame, key: str, at: str, top: int, products: Column | None = None, own: list[str] | None = None) -> DataFrame:
    """The keys of the newest records, at most top; with own products, of records that share one or name none."""
    if products is not None and own:
        records = records.where((F.size(products) == 0) | F.arrays_overlap(products, F.array(*map(F.lit, own))))
    return records.groupBy(key).agg(F.max(at).alias("newest")).orderBy(F.desc("newest"), key).limit(top)


def timeline(versions: DataFrame, key: str, order: list[Column], top: int) -> DataFrame:
    """The newest rows of each key, numbered."""
    return versions.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n") <= top)

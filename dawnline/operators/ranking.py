"""Versions, sections, caps, budgets, exclusion by history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnline.functions import fixed


def rank_of(level: Column, order: list[str]) -> Column:
    """Place of a level in its order, from 0; null for other levels."""
    return F.create_map(*(x for i, name in enumerate(order) for x in (F.lit(name), F.lit(i))))[level]


def at_least(level: Column, minimum: str, order: list[str], fallback: str) -> Column:
    """Whether a level reaches the minimum (an unknown minimum counts as fallback); unknown levels never do."""
    return F.coalesce(rank_of(level, order) >= order.index(minimum if minimum in order else fallback), F.lit(False))


def risk_at_least(level: Column, minimum: str) -> Column:
    return at_least(level, minimum, fixed.RISKS, "high")


def evidence_at_least(level: Column, minimum: str) -> Column:
    return at_least(level, minimum, fixed.EVIDENCES, "ms_official")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def numbered(df: DataFrame, keys: list[str], order: list[Column], previous: list[str]) -> DataFrame:
    """df with version (from 1) and the previous version's columns (prev_ before their names)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"version": F.row_number().over(w), **{f"prev_{c}": F.lag(c).over(w) for c in previous}})


def capped_sections(df: DataFrame, section: str, order: list[Column], caps: dict[str, int], default_cap: int, first: str, total: int) -> DataFrame:
    """df with section_rank, position and overflow: each section's cap, then the total over sections in the caps' order.

    overflow is how many rows of a section the caps have cut. The first section is never cut by the total. Sections are cut before the total is counted, so that the one window over
    all sections sees no more rows than the caps add up to.
    """
    names = list(caps)
    place = F.create_map(*(x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))))
    cap = F.coalesce(F.create_map(*(x for s, c in caps.items() for x in (F.lit(s), F.lit(c))))[F.col(section)], F.lit(default_cap))
    ranked = df.where(F.col(section).isin(names)).withColumn("section_rank", F.row_number().over(Window.partitionBy(section).orderBy(*order)))
    # the literal bound lets Spark cut each section within every partition before the shuffle
    ranked = ranked.where(F.col("section_rank") <= max(*caps.values(), default_cap))
    within = ranked.where(F.col("section_rank") <= cap).withColumn("_place", place[F.col(section)])
    overall = within.withColumn("position", F.row_number().over(Window.orderBy("_place", "section_rank")))
    kept = overall.where((F.col("position") <= total) | (F.col(section) == first)).drop("_place")
    # no more rows here than sections: what there was of each, less what is kept
    sizes = df.where(F.col(section).isin(names)).groupBy(section).agg(F.count("*").alias("_all"))
    left = kept.groupBy(section).agg(F.count("*").alias("_kept")).join(sizes, section).select(section, (F.col("_all") - F.col("_kept")).alias("overflow"))
    return kept.join(F.broadcast(left), section)


def within_budget(df: DataFrame, order: list[Column], cost: str, budget: float, calls: int, batch: int, part: str | None = None) -> DataFrame:
    """The rows that a budget of cost and calls allows in order, with their batch number from 0.

    A row is taken while what was spent before it is below the budget. part: budgets of their own (a day, say), which is
    what keeps the windows small.
    """
    keys = [part] if part else []
    w = Window.partitionBy(*keys).orderBy(*order)
    spent = F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # calls first: each partition keeps no more rows of a part than may be called, and the sums run over these alone
    few = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= calls)
    out = few.withColumn("spent_before", spent).where(F.col("spent_before") < budget)
    return out.withColumn("batch", F.floor((F.col("_n") - 1) / batch).cast("int")).drop("_n")


def resurface(row_version: Column, read_version: Column, muted_version: Column, risk: Column, purpose: str, read: str = "notify", muted: str = "silent") -> Column:
    """Whether a version of something read or muted (their versions; null: neither) may be shown again.

    Policies: read is notify, bulletin_only or silent; muted is notify, critical_only or silent; purpose bulletin or alert.
    """
    muted_ok = {"silent": F.lit(False), "critical_only": risk == "critical"}.get(muted, F.lit(True))
    read_ok = F.lit(False) if read == "silent" or (read == "bulletin_only" and purpose == "alert") else F.lit(True)
    return (muted_version.isNull() | ((muted_version < row_version) & muted_ok)) & (read_version.isNull() | ((read_version < row_version) & read_ok))


def not_in_history(df: DataFrame, history: DataFrame, key: str) -> DataFrame:
    return df.join(history.select(key), key, "left_anti")


def in_history(df: DataFrame, history: DataFrame, key: str) -> DataFrame:
    return df.join(history.select(key), key, "left_semi")


def page(df: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """One page (from 1) by a take-ordered plan, with the total and the number of pages on each row."""
    total = df.count()
    rows = df.orderBy(*order).limit(number * size).offset((number - 1) * size) if number > 1 else df.orderBy(*order).limit(size)
    return rows.withColumns({"total": F.lit(total).cast("long"), "pages": F.ceil(F.lit(total) / size).cast("long")})


def next_attempt(attempts: Column, at: Column, retry_after: Column) -> Column:
    """When a failed delivery is tried again: 1, 5, 15, 60, 180 min after its 1st to 5th try or as asked; null after 6."""
    minutes = F.element_at(F.array(*map(F.lit, (1, 5, 15, 60, 180))), F.least(attempts, F.lit(5)))
    seconds = F.coalesce(retry_after, minutes * 60)
    return F.when(attempts < 6, F.timestamp_seconds(F.unix_timestamp(at) + seconds))


def after_attempt(sent: Column, attempts: Column, at: Column, retry_after: Column) -> Column:
    """struct of state (sent, retry or failed) and next_at of a delivery after an attempt."""
    again = next_attempt(attempts, at, retry_after)
    state = F.when(sent, "sent").when(attempts < 6, "retry").otherwise("failed")
    return F.struct(state.alias("state"), F.when(~sent, again).alias("next_at"))


def work_verdict(status: Column, at: Column, tries: Column, now: Column, running: str = "running", failed: str = "failed", sending: str = "sending") -> Column:
    """retry (failed for 10 minutes, at most 3 tries), stuck (running for 30 minutes), uncertain (sending for 30 minutes) or fine."""
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    return F.when((status == failed) & (tries <= 3) & (age > 600), "retry").when((status == running) & (age > 1800), "stuck").when((status == sending) & (age > 1800), "uncertain").otherwise("fine")

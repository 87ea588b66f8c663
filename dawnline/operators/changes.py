"""Change capture between polls, histories and user state as a fold of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def capture(current: DataFrame, batch: DataFrame, keys: list[str], content: list[str], order: list[Column]) -> DataFrame:
    """One row per key of either side: change (inserted, changed, unchanged, absent) and the content that now holds.

    Of repeated keys in the batch the first one counts. A null in the batch keeps the current value. One full outer join on
    the keys; the contents are compared by hash.
    """
    once = first_per_key(batch, keys, order).select(*keys, F.struct(*content).alias("_new"))
    held = current.select(*keys, F.struct(*content).alias("_old"))
    digest = lambda c: F.xxhash64(c)
    both = held.join(once, keys, "full_outer")
    merged = [F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")).alias(c) for c in content]
    change = (
        F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "absent")
        .when(digest(F.struct(*merged)) == digest(F.col("_old")), "unchanged").otherwise("changed")
    )
    return both.select(*keys, change.alias("change"), *merged)


def snapshots(captured: DataFrame) -> DataFrame:
    """Rows to append to the history: what was inserted or changed."""
    return captured.where(F.col("change").isin("inserted", "changed"))


def validity(history: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """history with valid_to (the next row's time; null for the newest) and the number of rows so far."""
    order = Window.partitionBy(*keys).orderBy(at, tie)
    return history.withColumns({"valid_to": F.lead(at).over(order), "nth": F.count("*").over(order.rowsBetween(Window.unboundedPreceding, 0))})


def with_first_run(observed: DataFrame, runs: DataFrame, source: str, seen_at: str, ok_at: str) -> DataFrame:
    """observed with first_run: seen no later than its source's first successful run."""
    first = runs.groupBy(source).agg(F.min(ok_at).alias("_first_ok"))
    return observed.join(first, source, "left").withColumn("first_run", F.coalesce(F.col(seen_at) <= F.col("_first_ok"), F.lit(True))).drop("_first_ok")


#: Actions that set and reset each state.
STATES = {"read": ("read", "unread"), "followed": ("follow", "unfollow"), "muted": ("mute", "unmute")}


def user_states(log: DataFrame, keys: list[str], action: str, at: str, tie: str) -> DataFrame:
    """One row per key: viewed_at, and for read, followed and muted whether and since when; relevance_delta.

    A state holds if its last set comes after its last reset, and dates from the first set after that reset. Every follow
    adds 3 to the relevance; an unfollow takes 3 away if the key was followed then.
    """
    moment = F.struct(at, tie)
    out = [F.max(F.when(F.col(action) == "view", F.col(at))).alias("viewed_at")]
    order = Window.partitionBy(*keys).orderBy(at, tie)
    marked = log
    for name, (_, reset) in STATES.items():
        marked = marked.withColumn(f"_{name}_reset", F.max(F.when(F.col(action) == reset, moment)).over(Window.partitionBy(*keys)))
    before = F.last(F.when(F.col(action).isin("follow", "unfollow"), F.col(action)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_delta", F.when(F.col(action) == "follow", 3).when((F.col(action) == "unfollow") & (before == "follow"), -3).otherwise(0))
    for name, (put, _) in STATES.items():
        after = (F.col(action) == put) & (F.col(f"_{name}_reset").isNull() | (moment > F.col(f"_{name}_reset")))
        out += [F.coalesce(F.bool_or(after), F.lit(False)).alias(name), F.min(F.when(after, F.col(at))).alias(f"{name}_at")]
    return marked.groupBy(*keys).agg(*out, F.sum("_delta").alias("relevance_delta"))

"""Structured Streaming forms: slots, exactly-once keys, late data, change capture, folds, bounded matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnline.workspace import ready, shared_path


def slots(stream: DataFrame, at: str, width: str, keys: list[str], late: str) -> DataFrame:
    """Counts by tumbling window and keys; rows later than late are left out once the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))


def once(stream: DataFrame, at: str, keys: list[str], within: str) -> DataFrame:
    """The first row of each key within the time."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def recent(stream: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows no older than days before now, under a watermark of the same length."""
    return stream.withWatermark(at, f"{days} days").where(F.col(at) >= F.expr(f"timestamp '{now}' - interval {days} days"))


def _idle_ms(idle: str) -> int:
    number, unit = idle.split()
    return int(float(number) * {"minute": 60, "hour": 3600, "day": 86400}[unit.removesuffix("s")] * 1000)


def _last_ms(times: pd.Series, state) -> int:
    """The last time, in ms, or the watermark if that is later."""
    return max(int(times.max().timestamp() * 1000), state.getCurrentWatermarkMs())


def changed_rows(stream: DataFrame, key: str, order: list[str], watched: list[str], idle: str = "45 days", late: str = "2 days", material: Callable[[tuple, tuple], bool] | None = None) -> DataFrame:
    """Rows whose watched columns are a material change against the key's last row that was emitted, numbered from 1; the state is that row.

    material(new, last) of the watched values decides; without it, any difference does. Small changes that are no material
    ones add up, for they are not what the next row is compared with. order begins with the event time. The state of a key is dropped once the watermark is the time idle beyond its last row;
    if the key comes back, it begins anew.
    """
    ready(stream.sparkSession)
    columns = [key, *order, *watched]
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in columns) + ", version int"
    state_schema = ", ".join(f"`{c}` {fields[c]}" for c in watched) + ", version int"
    wait = _idle_ms(idle)

    def fold(_key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *last, version = state.get if state.exists else (*[None] * len(watched), 0)
        last, rows = tuple(last), pd.concat(list(frames)).sort_values(order)
        kept, versions = [], []
        for i, row in enumerate(rows[watched].itertuples(index=False, name=None)):
            if not version or (row != last if material is None else material(row, last)):
                last, version = row, version + 1
                kept.append(i)
                versions.append(version)
        state.update((*(x.item() if hasattr(x, "item") else x for x in last), version))
        state.setTimeoutTimestamp(_last_ms(rows[order[0]], state) + wait)
        out = rows.iloc[kept][columns].copy()
        out["version"] = pd.Series(versions, index=out.index, dtype="int32")
        yield out

    return stream.select(*columns).withWatermark(order[0], late).groupBy(key).applyInPandasWithState(fold, schema, state_schema, "append", "EventTimeTimeout")


def followed(stream: DataFrame, key: str, action: str, order: list[str], idle: str = "365 days", late: str = "2 days") -> DataFrame:
    """After each batch, for each key seen in it: followed, and the relevance that follows and unfollows add up to.

    order begins with the event time. The state of a key is dropped once the watermark is the time idle beyond its last action.
    """
    ready(stream.sparkSession)
    wait = _idle_ms(idle)

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        on, points = state.get if state.exists else (False, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for what in rows[action]:
            if what == "follow":
                on, points = True, points + 3
            elif what == "unfollow":
                points -= 3 * on
                on = False
        state.update((on, points))
        state.setTimeoutTimestamp(_last_ms(rows[order[0]], state) + wait)
        yield pd.DataFrame({key: [k[0]], "followed": [on], "relevance_delta": [points]})

    schema = f"`{key}` long, followed boolean, relevance_delta long"
    return stream.select(key, action, *order).withWatermark(order[0], late).groupBy(key).applyInPandasWithState(fold, schema, "followed boolean, relevance_delta long", "update", "EventTimeTimeout")


def matched(stream: DataFrame, known: DataFrame, key: str, at: str, known_at: str, hours: int, late: str = "2 days") -> DataFrame:
    """Rows of a stream with those of another one of their key from the hours before them.

    Both have a watermark, and the bound on their times tells Spark when a row can meet nothing any more and leaves the state.
    """
    left = stream.withWatermark(at, late).alias("l")
    right = known.select(F.col(key).alias("_key"), F.col(known_at)).withWatermark(known_at, late).alias("r")
    near = F.expr(f"l.`{at}` >= r.`{known_at}` and l.`{at}` <= r.`{known_at}` + interval {hours} hours")
    return left.join(right, (F.col(f"l.{key}") == F.col("r._key")) & near).select("l.*", f"r.{known_at}")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream over files has for now, by way of a table in the shared folder; in complete mode the last batch."""
    spark = stream.sparkSession
    path, marks = shared_path(spark, "stream"), shared_path(spark, "marks")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)

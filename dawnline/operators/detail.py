"""All that is known of events: versions, evidence, deliveries and actions, from histories that are written bucketed by event.

A history that is bucketed and sorted by event is read without a shuffle, whatever is grouped, ranked or joined by event; only the
first rows of long histories are kept, by the rank within the event. Parts are rows of one table, not arrays, so that an event
with very many of them is no single value.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORIES = ["versions", "evidence", "snapshots", "deliveries", "actions"]
RECENT = 20


def write_histories(histories: dict[str, DataFrame], event: str = "event", buckets: int = 64) -> dict[str, str]:
    """The histories as tables of the warehouse, bucketed and sorted by event: the name of each. buckets grow with the data, not with the queries."""
    mark, names = uuid.uuid4().hex[:12], {}
    for kind, rows in histories.items():
        names[kind] = f"history_{kind}_{mark}"
        # one task a bucket, so that a bucket is one sorted file
        rows.repartition(buckets, event).write.bucketBy(buckets, event).sortBy(event).saveAsTable(names[kind])
    return names


def drop_histories(spark: SparkSession, names: dict[str, str]) -> None:
    for name in names.values():
        spark.sql(f"drop table if exists {name}")


@contextmanager
def by_event_alone(spark: SparkSession) -> Iterator[None]:
    """Plans made within may join by event and more on tables that are bucketed by event, without a shuffle."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def event_details(spark: SparkSession, names: dict[str, str], trust: Column, top: int = RECENT) -> DataFrame:
    """event, part, place, id, at, label, count of every event's parts.

    versions (event, id, at, label) and evidence (event, id, at, label, url, source) are told whole, the newest version and
    the first seen evidence first; evidence has the trust that the column tells, and the number of its snapshots (event, id,
    at) as count. No id is twice in an event. Run it within by_event_alone(). Of deliveries and actions (event, id, at, label) the newest top are told.
    """
    read = {kind: spark.table(name) for kind, name in names.items()}
    ranked = lambda rows, *order: rows.withColumn("place", F.row_number().over(Window.partitionBy("event").orderBy(*order)))
    columns = ["event", "part", "place", "id", "at", "label", "count"]
    told = lambda rows, part: rows.select("event", F.lit(part).alias("part"), "place", "id", "at", "label", F.lit(None).cast("long").alias("count"))
    counts = read["snapshots"].groupBy("event", "id").agg(F.count("*").alias("count"))
    evidence = ranked(read["evidence"].join(counts, ["event", "id"], "left"), "at", "id")
    evidence = evidence.select("event", F.lit("evidence").alias("part"), "place", "id", "at", F.concat_ws(": ", trust, "label").alias("label"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))
    out = told(ranked(read["versions"], F.desc("id")), "version").union(evidence)
    for part in ("deliveries", "actions"):
        out = out.union(told(ranked(read[part], F.desc("id")).where(F.col("place") <= top), {"deliveries": "delivery", "actions": "action"}[part]))
    return out.select(*columns)

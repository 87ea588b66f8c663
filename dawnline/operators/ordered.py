"""Places and predecessors over long orders: sorted by range, so that no task sees more than its range of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnline.workspace import stored


def _ranges(df: DataFrame, parts: list[str], order: list[Column]) -> DataFrame:
    """df sorted over all its ranges by parts and order, each row with the number of its range; kept as a table."""
    ranged = df.repartitionByRange(*(F.col(p) for p in parts), *order)
    return stored(df.sparkSession, ranged.withColumn("_range", F.spark_partition_id()), "ranges")


def placed(df: DataFrame, parts: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place, from 1, among those of its parts; order must tell all rows apart.

    A range counts its rows of each part; the counts of the ranges before, a row per range and part, are added to the
    places within the range.
    """
    rows = _ranges(df, parts, order)
    counts = rows.groupBy(*parts, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = rows.withColumn(name, F.row_number().over(Window.partitionBy(*parts, "_range").orderBy(*order)))
    on = [F.col(f"w.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*parts, "_range")]
    joined = within.alias("w").join(counts.alias("c"), on)
    return joined.select(*(F.col(f"w.{c}") for c in df.columns if c != name), (F.col(f"w.{name}") + F.col("c._before")).cast("long").alias(name))


def with_previous(df: DataFrame, parts: list[str], order: list[Column], columns: list[str], prefix: str = "previous_") -> DataFrame:
    """df with the columns of the row before it in its parts; order must tell all rows apart.

    Within a range it is the row before; the first row of a part in a range takes the last one of the ranges before.
    """
    rows = _ranges(df, parts, order)
    w = Window.partitionBy(*parts, "_range").orderBy(*order)
    kept = F.struct(*columns)
    within = rows.withColumns({"_before": F.lag(kept).over(w), "_n": F.row_number().over(w)})
    lasts = rows.groupBy(*parts, "_range").agg(F.max_by(kept, F.struct(*order)).alias("_last"))
    lasts = lasts.withColumn("_last", F.last("_last", ignorenulls=True).over(Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    on = [F.col(f"w.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*parts, "_range")]
    joined = within.alias("w").join(lasts.alias("c"), on)
    before = F.when(F.col("w._n") > 1, F.col("w._before")).otherwise(F.col("c._last"))
    return joined.select(*(F.col(f"w.{c}") for c in df.columns), *(before[c].alias(f"{prefix}{c}") for c in columns))

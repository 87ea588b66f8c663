"""Tables that jobs keep: snapshots by date, a current state in versions, and outputs written once per slot."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnline.operators import changes


def append_snapshots(rows: DataFrame, path: str, captured: Column) -> None:
    """Append rows to a table partitioned by the date on which they were captured."""
    rows.withColumn("capture_date", captured.cast("date")).write.mode("append").partitionBy("capture_date").parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class CurrentState:
    """The newest row of each key, as a table that is written anew, next to the old one, by every upsert.

    A version counts once it stands in the list of versions, which is appended to after its data are complete: a job that
    dies before leaves the last version as it was, and running it again does the same once more.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], content: list[str]):
        self.spark, self.root, self.keys, self.content = spark, root, keys, content

    def _last(self) -> int | None:
        return _read(self.spark, f"{self.root}/versions", "version int").agg(F.max("version")).first()[0]

    def read(self) -> DataFrame | None:
        last = self._last()
        return None if last is None else self.spark.read.parquet(f"{self.root}/state-{last:06d}")

    def upsert(self, batch: DataFrame, order: list[Column]) -> DataFrame:
        """Take in a batch, in which a key's first row in order counts; returns the captured changes, from the new version."""
        last, current = self._last(), self.read()
        if current is None:
            current = batch.limit(0)
        captured = changes.capture(current.select(*self.keys, *self.content), batch, self.keys, self.content, order)
        path = f"{self.root}/state-{(last or 0) + 1:06d}"
        captured.write.mode("overwrite").parquet(path)
        self.spark.range(1).select(F.lit((last or 0) + 1).cast("int").alias("version")).write.mode("append").parquet(f"{self.root}/versions")
        return self.spark.read.parquet(path)


def write_slots(rows: DataFrame, root: str, slot: str) -> None:
    """Write rows partitioned by slot, but those of slots that are done; a slot is done once all its rows are written.

    Partitions are overwritten, so that one half written by a job that died is replaced, and written again is written once.
    """
    spark = rows.sparkSession
    kind = rows.schema[slot].dataType.simpleString()
    done = _read(spark, f"{root}/done", f"`{slot}` {kind}")
    new = rows.join(done.distinct(), slot, "left_anti")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(slot).parquet(f"{root}/rows")
    new.select(slot).distinct().write.mode("append").parquet(f"{root}/done")

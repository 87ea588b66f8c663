"""Ordered folds that stream: the rows of a key pass one after the other, and only what the fold remembers is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnline.workspace import ready


def emitted(history: DataFrame, key: str, order: list[str], watched: list[str], material: Callable[[tuple, tuple], bool]) -> DataFrame:
    """Rows that make a version: a key's first one, and each that differs materially from the last one that made a version.

    material(last, row) compares the watched columns of two rows. Small changes that make no version add up until they do.
    Rows equal to the one before are dropped in the JVM first. The rest is sorted by key and order and read batch by batch,
    so that a task holds one batch and one row of the key it is at, however long the key's history is.
    """
    ready(history.sparkSession)
    state = F.struct(*watched)
    thinned = history.withColumn("_same", state == F.lag(state).over(Window.partitionBy(key).orderBy(*order))).where("_same is null or not _same")
    columns = [key, *order, *[c for c in watched if c not in order]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, version, begun = None, None, 0, False
        for batch in batches:
            kept, numbers = [], []
            keys, rows = batch.column(key).to_pylist(), zip(*(batch.column(c).to_pylist() for c in watched), strict=True)
            for i, (k, row) in enumerate(zip(keys, rows, strict=True)):
                if not begun or k != at:
                    at, last, version, begun = k, None, 0, True
                if last is None or material(last, row):
                    last, version = row, version + 1
                    kept.append(i)
                    numbers.append(version)
            out = batch.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(numbers, pa.int32())], names=[*out.schema.names, "version"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in thinned.select(*columns).schema.fields)
    return thinned.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInArrow(fold, f"{schema}, version int")

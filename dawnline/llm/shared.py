"""Helpers of the subpackage: bounded caches and groups of sorted batches."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dawnline.workspace import ready, scratch, shared_path, stored

__all__ = ["CACHE_BYTES", "Memo", "forget", "grouped", "held", "ready", "scratch", "shared_path", "stored", "unused", "word_slices"]

#: What a per-worker cache holds before it starts anew, and the largest entry that it keeps; results depend on neither.
CACHE_BYTES, ENTRY_BYTES, SLOT_BYTES = 64 << 20, 2 << 10, 104


_held: list = []


def held(make: Callable, *args):
    """make(*args), kept in this worker until something else is asked for: one model and its caches at a time."""
    if not _held or _held[0] != (make, args):
        forget()
        _held[:] = [(make, args), make(*args)]
    return _held[1]


def forget() -> None:
    """Give back what this worker keeps of a model and has freed since, also to the system: it outlives the stage that it has worked for."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


class Memo(dict):
    """A dict that fills itself through make(key) and starts anew when limit bytes are full; large entries are not kept."""

    def __init__(self, make: Callable, limit: int = CACHE_BYTES):
        super().__init__()
        self.make, self.limit, self.size = make, limit, 0

    def __missing__(self, key):
        value = self.make(key)
        size = SLOT_BYTES + getsizeof(key) + getsizeof(value)
        if size > ENTRY_BYTES:
            return value
        self.size += size
        if self.size > self.limit:
            self.clear()
            self.size = size
        self[key] = value
        return value


_SPACE = re.compile(rb"[ \t-\r]")


def word_slices(data: bytes, size: int = 1 << 18) -> Iterator[list[bytes]]:
    """The words (runs without ASCII white space) of data in order, in lists of about size bytes; words are never cut."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            space = _SPACE.search(data, end)
            end = space.start() if space else len(data)
        yield data[start:end].split()
        start = end


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as make it differ from all of df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key of batches that are sorted by integer keys, one table a key."""
    left: pa.Table | None = None  # the last key's rows so far, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([left, table]) if left is not None else table
        columns = np.stack([table[k].to_numpy() for k in keys])
        starts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1)]
        for s, e in zip(starts, starts[1:], strict=False):
            yield table.slice(s, e - s)
        left = table.slice(starts[-1])
    if left is not None:
        yield left

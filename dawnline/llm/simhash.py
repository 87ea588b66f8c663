"""Near-duplicate documents by SimHash fingerprints, joined by a grid over the bit counts of their segments.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles,
repeats included. Fingerprints with at most two differing bits are linked. To find the links, a fingerprint becomes a point:
the number of set bits in each of its 32 two-bit segments. The Manhattan distance of two points never exceeds the number of
differing bits, and it is a whole number, so that two points within a distance of two have a cell of the unit grid within
one step of both. Every distinct fingerprint is dealt to its own cell and the cells one step away (33 to 65 rows, 49 on the
average), cells that hold several fingerprints are joined to their members, and these are compared bit by bit in tasks.

- A cell of at most BLOCK members is compared in one task, which gives a star of edges for each of its groups, and not pairs.
- Members of larger cells are dealt anew: two fingerprints that differ in two bits agree in at least six of eight bytes, so
  each goes to 28 buckets, one for each choice of six bytes. The others leave 16 bits free: no bucket has over 65,536 members,
  and neighbours are found there by looking up each member with one or two bits turned, in time linear in the members.

Both ways are exact and emit at most one edge for a row. Equal fingerprints are one node with the smallest doc_id; a table
of nodes with copies or links names the component of every row.

Defined results: a text without words (null, empty, white space) has the fingerprint zero and is linked like any other; one
with fewer words than a shingle is the whole sequence as one shingle; a very long text is read in slices, never cut short.
Ties (a bit that is set in exactly half of the hashes) give an unset bit. Each row of a repeated doc_id has the component of
its own fingerprint. A row without doc_id can't be named: it links nothing and its component is null. Extra columns of any
name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnline.llm.shared import grouped, ready, stored, word_slices
from dawnline.operators.graph import components

SEED, WORDS, MOST_BITS, BLOCK = 42, 3, 2, 512
_LOW = np.uint64(0x5555555555555555)  # the lower bit of each segment
_STEPS = np.uint64(1) << np.arange(0, 64, 2, dtype=np.uint64)
_BYTES = [np.uint64(0xFF << 8 * i) for i in range(8)]
#: Every choice of two free bytes, as the mask of the six others.
FREE = [~(_BYTES[i] | _BYTES[j]) for i, j in combinations(range(8), 2)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, k: int = WORDS) -> int:
    """The fingerprint of the whole text, as an unsigned 64-bit number."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    ones, n, last = np.zeros(64, dtype=np.int64), 0, []
    for words in word_slices(data):
        words = last + words
        if len(words) >= k:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - k + 1)
            ones, n = ones + _bit_counts(hashes), n + len(hashes)
        last = words[max(0, len(words) - k + 1) :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED) if last else 0
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(df: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of each row."""
    ready(df.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), k) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(make, "doc_id long, fp long")


def grid_cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fp) of each fingerprint's own cell and of those one step away; a cell packs the 32 counts, two bits each."""
    own = fps - ((fps >> np.uint64(1)) & _LOW)
    count = (own[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    around = np.concatenate([own[:, None], own[:, None] + _STEPS, own[:, None] - _STEPS], axis=1)
    there = np.concatenate([np.ones((len(fps), 1), dtype=bool), count < 2, count > 0], axis=1)
    return around[there], np.broadcast_to(fps[:, None], around.shape)[there]


def _cells(nodes: DataFrame) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, fps = grid_cells(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(fps.view(np.int64))], names=["cell", "fp"])

    return nodes.select("fp").mapInArrow(deal, "cell long, fp long")


def _spread(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is connected with by the edges (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def group_roots(fps: np.ndarray) -> np.ndarray:
    """For each of distinct fingerprints, the place of the first one that it is connected with by links among them."""
    if len(fps) <= BLOCK:
        return _spread(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= MOST_BITS))
    order = np.argsort(fps)
    ranked = fps[order]
    free = int(np.bitwise_or.reduce(fps ^ fps[0]))
    single = [1 << b for b in range(64) if free >> b & 1]
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for turned in single + [x | y for x, y in combinations(single, 2)]:
        near = ranked ^ np.uint64(turned)
        at = np.minimum(np.searchsorted(ranked, near), len(ranked) - 1)
        i = np.flatnonzero(ranked[at] == near)
        ends.append((i[i < at[i]], at[i][i < at[i]]))
    label = _spread(len(fps), np.concatenate([i for i, _ in ends]), np.concatenate([j for _, j in ends]))
    out = np.empty(len(fps), dtype=np.int64)
    out[order] = order[label]
    return out


def _stars(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b) that connect what is linked among the rows (keys, fp) of each key; no fingerprint is twice in one key."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        held = 0
        for group in grouped(batches, keys):
            fps = group["fp"].to_numpy().view(np.uint64)
            if len(fps) == 2:
                if (int(fps[0]) ^ int(fps[1])).bit_count() > MOST_BITS:
                    continue
                left.append(fps[:1])
                right.append(fps[1:])
                held += 1
            elif len(fps) > 2:
                root = group_roots(fps)
                off = np.flatnonzero(root != np.arange(len(fps)))
                left.append(fps[root[off]])
                right.append(fps[off])
                held += len(off)
            if held > 10_000:
                yield edges(left, right)
                left, right, held = [], [], 0
        if held:
            yield edges(left, right)

    def edges(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])

    return rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fp of nodes that connect just what is within MOST_BITS bits, step by step."""
    spark = nodes.sparkSession
    sizes = _cells(nodes).groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    # a table, whose size Spark knows, before the cells meet it again: those of a hot one are dealt over many tasks
    members = stored(spark, _cells(nodes).join(stored(spark, sizes, "cells"), "cell"), "members")
    edges = _stars(members.where(F.col("size") <= BLOCK), ["cell"])
    large = members.where(F.col("size") > BLOCK).select("fp").distinct()
    if not large.isEmpty():
        kept = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))).alias("bits")) for i, m in enumerate(FREE)])
        edges = edges.union(_stars(large.select("fp", F.inline(kept)), ["choice", "bits"]))
    return edges.distinct()


def near_duplicates(df: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links) and kept, for each row of df."""
    spark = df.sparkSession
    rows = stored(spark, fingerprints(df, k, id_col, text_col), "fingerprints")
    nodes = stored(spark, rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "nodes")
    edges = stored(spark, links(nodes), "links")
    ends = edges.join(nodes.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b")
    labels = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # only fingerprints with copies or links need a name; a table, so that the rows of a hot one are dealt over many tasks
    named = nodes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or label is not null")
    named = stored(spark, named.select("fp", F.coalesce("label", "rep").alias("component")), "named")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = rows.join(named, "fp", "left").select("doc_id", "fp", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def hexadecimal(fp: str):
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

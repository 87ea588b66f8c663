"""How filters of documents interact: what each removes in every order of the filters, by counting paths of a lattice.

A document is reduced to the set of filters that it fails, and the table to one row for each part and set, with counts. The
sets of filters that have run so far are the states of the subset lattice; running one more filter is an edge. forward(S) is
the number of orders in which S is reached, backward(S) the number in which it is left for the end; an edge from S to T lies
on forward(S) * backward(T) of the orders. What a filter removes on an edge depends on S only, not on the order in it, so
that all orders are read from the edges (80 for five filters) instead of from the rows: a step of an order is an edge, and
the removals of an edge, weighted with its orders, add up to the filter's Shapley value times the number of orders.

Filters run in any order, or in those orders that keep given pairs (earlier, later).

Defined results: a null text is empty; an empty text has no words and no characters, so that only conditions that hold for
nothing fail it. Null parts are the empty string. Texts are equal if their SHA-256 is; a row repeats another if that has the
same text and a smaller doc_id, so that rows of one doc_id don't repeat each other, and a row without doc_id repeats nothing.
Repeated labels of one document count once, as 1 if any is 1; documents without labels count as 0. Very long texts are read
in slices; only their distinct words are held. Extra columns of any name are ignored; an empty table gives no rows, and every
other part has a row for each order and step, zeros included.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Sequence
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnline.llm.shared import ready, stored, word_slices

#: Orders grow with the factorial of the filters; 7 filters have 5,040.
MOST_FILTERS = 7
FACTS = "struct<words long, distinct_words long, capitals long, points long, marks long, digest binary>"
_CAPITALS = string.ascii_uppercase.encode()
_MARKS = re.compile(rb"[#$%&*|]")


def facts(text: str | None) -> tuple[int, int, int, int, int, bytes]:
    """Words, distinct words, A-Z, code points, marks of the set #$%&*| and SHA-256 of the whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words, seen = 0, set()
    for part in word_slices(data):
        words += len(part)
        seen.update(part)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return words, len(seen), capitals, len(text), len(_MARKS.findall(data)), hashlib.sha256(data).digest()


def text_facts(text_col: str) -> Column:
    """The facts of a text column, as a struct."""

    @F.arrow_udf(FACTS)
    def of(texts: pa.Array) -> pa.Array:
        found = [facts(t.as_py()) for t in texts]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        names = ["words", "distinct_words", "capitals", "points", "marks", "digest"]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], names=names)

    return of(text_col)


def path_counts(n: int, before: Sequence[tuple[int, int]] = ()) -> tuple[list[int], list[int]]:
    """For each set of n filters, as a bit mask: the number of orders that reach it, and of those that lead on from it to all n."""
    forward, backward = [1] + [0] * (2**n - 1), [0] * (2**n - 1) + [1]
    for state in range(2**n):
        for x in _next(state, n, before):
            forward[state | 1 << x] += forward[state]
    for state in reversed(range(2**n)):
        for x in _next(state, n, before):
            backward[state] += backward[state | 1 << x]
    return forward, backward


def _next(state: int, n: int, before: Sequence[tuple[int, int]]) -> list[int]:
    return [x for x in range(n) if not state >> x & 1 and all(state >> a & 1 for a, b in before if b == x)]


def lattice_edges(n: int, before: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int, int]]:
    """(state, filter that runs next, number of orders that take this edge) of the edges that an order can take."""
    forward, backward = path_counts(n, before)
    edges = [(s, x, forward[s] * backward[s | 1 << x]) for s in range(2**n) for x in _next(s, n, before)]
    return [e for e in edges if e[2]]


def repeated(rows: DataFrame, out: str = "repeats") -> DataFrame:
    """rows (doc_id, digest, ..) with out: whether a row of smaller doc_id has the same digest."""
    many = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a table, so that the rows of a much copied text are dealt over many tasks
    many = stored(rows.sparkSession, many, "firsts")
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return rows.join(many, "digest", "left").withColumn(out, later).drop("first_id")


def fail_mask(conditions: Sequence[Column]) -> Column:
    """The failed filters as bits, the first filter's lowest; a null condition doesn't fail."""
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)]
    return sum(bits[1:], bits[0]).cast("int")


def audited(rows: DataFrame, letters: str, kinds: Sequence[str] = (), before: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """From rows (part string, mask int, a boolean column for each of kinds), one row for each part, order and step.

    filter_order, step (from 1), kept, removed, redundant, unique_fails, a column <kind>_lost for each of kinds, and
    shapley, the filter's removals summed over all orders. letters name the filters, the mask's lowest bit first; before
    has pairs of letters of which the first always runs before the second.
    """
    n, spark = len(letters), rows.sparkSession
    if not 1 <= n <= MOST_FILTERS or len(set(letters)) < n:
        raise ValueError(f"1 to {MOST_FILTERS} filters with different letters, not {letters!r}")
    pairs = [(letters.index(a), letters.index(b)) for a, b in before]
    edges = lattice_edges(n, pairs)
    if not edges:
        raise ValueError(f"no order keeps {before}")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.count_if(k).alias(k) for k in kinds])
    # each of the 2^n sets of a part meets all edges: a constant number of rows a part
    each = counts.withColumn("edge", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(x).alias("filter"), F.lit(1 << x).alias("own"), F.lit(w).cast("long").alias("orders")) for s, x, w in edges])))
    each = each.select("part", "mask", "n", *kinds, "edge.*")
    fails, gone, only = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("state")) != 0, F.col("mask") == F.col("own")

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    lost = [total(fails & ~gone, k).alias(f"{k}_lost") for k in kinds]
    at_edges = each.groupBy("part", "state", "filter", "orders").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(only).alias("unique_fails"), *lost
    )
    at_edges = at_edges.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter")))
    steps = []
    for order in permutations(range(n)):
        if all(order.index(a) < order.index(b) for a, b in pairs):
            steps += [("".join(letters[x] for x in order), i + 1, sum(1 << x for x in order[:i]), x) for i, x in enumerate(order)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    # at most MOST_FILTERS! * MOST_FILTERS rows, whatever the input
    out = at_edges.join(F.broadcast(steps), ["state", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{k}_lost" for k in kinds], "shapley")


def document_masks(docs: DataFrame, labels: DataFrame, conditions: dict[str, str], part_col: str = "lang") -> DataFrame:
    """part, mask, good and toxic of each row of docs (doc_id, text, part_col).

    conditions are SQL expressions of the facts (words, distinct_words, capitals, points, marks, repeats) by letter; labels
    has doc_id, quality and toxic.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text_facts("text").alias("facts"))
    # read and shuffled twice, without the texts
    rows = stored(docs.sparkSession, rows.select("doc_id", "part", "facts.*"), "facts")
    rows = repeated(rows).select("doc_id", "part", fail_mask([F.expr(c) for c in conditions.values()]).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    return rows.join(marks, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))

"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND for every training passage.

An item's impact of a term is its BM25 weight divided by the item's own threshold, a share of the score that the item has
against itself, so that one threshold of 1 holds for all items. Items with the same common words stand together, and all
postings are cut into blocks at the same items, each with its largest impact. For a passage, the maxima of its terms'
blocks are added up range by range; only ranges in which they reach 1 are live, and all others are passed over. In a live
range the cursors of the terms move on by WAND, with the blocks' maxima as bounds. Items of like length have lists of their
own, so that a long item doesn't stretch the passages of the others.

Documents are cut into overlapping passages, so that any run of words as long as the longest item of a length is whole
within one. Each passage is a query, and every item that reaches the threshold is retrieved and verified on the passage's
words: it counts as contaminated if enough of the question's word n-grams, and of the answer's, occur in the passage. An
item's question is all but its last sentence, its answer the last one; an item of one sentence is a question without an answer.

The index is built in parts of about PART_ITEMS items and PART_BYTES of text at most, dealt by hash; each is sent to all
tasks in its turn. With more than one, the documents with what has been found are written as a table after each.
BM25's statistics are those of a part.

Words are runs of letters, digits and underscores, lower-cased. Defined results: null or empty text has no passages and
no items; a very long text is searched whole, passage by passage; items without words are ignored; an item of fewer words
than an n-gram is found wherever its words stand in a row; with an empty benchmark nothing is found, and an empty table
gives no rows; equal items count once, equal texts under several ids are reported under each, ordered by id; repeated rows
are searched one by one; extra columns pass unchanged and an existing column named like the output is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnline.llm.shared import ready, stored, unused

PART_ITEMS, PART_BYTES = 20_000, 8 << 20
K1, B, SHARE, GRAM, QUESTION, ANSWER, BLOCK, LENGTH = 1.2, 0.75, 0.6, 3, 0.7, 0.5, 4, 64
_REACHED = 1 - 1e-9
_ITEM = itemgetter(0)
_WORDS = re.compile(r"\w+").findall
_SENTENCES = re.compile(r"(?<=[.?!])\s+|\n+").split


def words(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def _grams(tokens: list[int], n: int) -> set[tuple]:
    n = min(n, len(tokens))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


@dataclass
class Item:
    item_id: int | None
    question: list[int]
    answer: list[int]
    terms: dict[int, float] = field(default_factory=dict)
    parts: tuple = ()

    @property
    def words(self) -> int:
        return len(self.question) + len(self.answer)


class Block:
    """The items of one term within one range of items, ascending, with their impacts and the largest of these."""

    def __init__(self, rows: list[tuple[int, float]]):
        self.items, self.impacts = [i for i, _ in rows], [x for _, x in rows]
        self.top = max(self.impacts)


class Lists:
    """The postings of items of like length, in blocks; all lists are cut at the same items, every BLOCK of them a range."""

    def __init__(self, items: list[Item], share: float, terms: int):
        n, df = len(items), Counter(t for item in items for t in {*item.question, *item.answer})
        mean = sum(item.words for item in items) / n
        rank = {t: i for i, (t, _) in enumerate(sorted(df.items(), key=lambda x: (-x[1], x[0])))}
        # items with the same common words side by side, so that ranges differ in what they hold
        self.items = sorted(items, key=lambda item: sorted(rank[t] for t in {*item.question, *item.answer}))
        self.longest, self.ranges = max(item.words for item in items), -(-n // BLOCK)
        rows: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for i, item in enumerate(self.items):
            impact = {
                t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * item.words / mean))
                for t, f in Counter(item.question + item.answer).items()
            }
            limit = share * sum(impact.values())
            item.terms = {t: x / limit for t, x in impact.items()}
            item.parts = tuple((n, _grams(part, n)) for part in (item.question, item.answer) for n in [min(GRAM, len(part))])
            for t, x in item.terms.items():
                rows[t, i // BLOCK].append((i, x))
        blocks = {key: Block(r) for key, r in sorted(rows.items())}
        self.by_range: list[dict[int, Block]] = [{} for _ in range(self.ranges)]
        for (t, at), block in blocks.items():
            self.by_range[at][t] = block
        # the blocks' ranges and maxima as arrays: those of term t are first[t] to first[t + 1]
        self.first = np.zeros(terms + 1, dtype=np.int64)
        np.cumsum(np.bincount([t for t, _ in blocks], minlength=terms), out=self.first[1:])
        self.at = np.array([at for _, at in blocks], dtype=np.int64)
        self.tops = np.array([b.top for b in blocks.values()])

    def live(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, range) pairs in which the block maxima of the passage's terms add up to 1: no other can hold a result.

        Passage p is 4 * longest words from word 3 * longest * p on; -1 is a word that no item has.
        """
        step, passages = 3 * self.longest, self.passages(len(tokens))
        place = np.flatnonzero(tokens >= 0)
        own = place // step
        # words at the start of a passage are at the end of the one before, too
        early = (place - own * step < self.longest) & (own > 0)
        p, t = np.concatenate([own, own[early] - 1]), np.concatenate([tokens[place], tokens[place[early]]])
        pairs = np.unique(p * len(self.first) + t)
        p, t = np.divmod(pairs[pairs // len(self.first) < passages], len(self.first))
        n = self.first[t + 1] - self.first[t]
        blocks = np.repeat(self.first[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        bounds = np.bincount(np.repeat(p, n) * self.ranges + self.at[blocks], self.tops[blocks], passages * self.ranges)
        return np.divmod(np.flatnonzero(bounds >= _REACHED), self.ranges)

    def passages(self, words: int) -> int:
        return max(1, -(-(words - self.longest) // (3 * self.longest)))

    def search(self, terms: set[int], at: int) -> list[tuple[int, float]]:
        """WAND within one range: (item row, score) of all its items with a score of 1 or more."""
        # a cursor: the item that it stands at, the place in the block, the block
        blocks = self.by_range[at]
        cursors = [[b.items[0], 0, b] for b in map(blocks.__getitem__, terms & blocks.keys())]
        found = []
        while True:
            cursors.sort(key=_ITEM)
            bound = 0.0
            for cursor in cursors:
                bound += cursor[2].top
                if bound >= _REACHED:
                    break
            else:
                return found  # no item from here on can reach 1
            pivot = cursor[0]
            if cursors[0][0] == pivot:
                score = sum(b.impacts[place] for item, place, b in cursors if item == pivot)
                if score >= _REACHED:
                    found.append((pivot, score))
                pivot += 1
            for cursor in cursors:
                if cursor[0] < pivot:
                    items = cursor[2].items
                    cursor[1] = place = bisect_left(items, pivot, cursor[1])
                    cursor[0] = items[place] if place < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]


class Index:
    """The vocabulary of the items and their lists, by length."""

    def __init__(self, rows: list[tuple[int | None, str | None]], share: float = SHARE):
        self.vocabulary: dict[str, int] = {}
        by_length: dict[int, list[Item]] = defaultdict(list)
        for item_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            parts = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(s)] for s in _SENTENCES((text or "").strip())]
            parts = [p for p in parts if p]
            if not parts:
                continue
            answer = parts.pop() if len(parts) > 1 else []
            item = Item(item_id, [t for p in parts for t in p], answer)
            by_length[((item.words - 1) // LENGTH).bit_length()].append(item)
        self.lists = [Lists(items, share, len(self.vocabulary)) for _, items in sorted(by_length.items())]

    def contained(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question overlap, answer overlap) of each item in text, at its best passage, in order of items."""
        if not text or not self.lists:
            return []
        found = words(text)
        tokens = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))
        out = []
        for lists in self.lists:
            best: dict[int, tuple[float, float, float]] = {}
            passages, ranges = lists.live(tokens)
            last, passage, terms, grams = -1, [], set(), {}
            for p, r in zip(passages.tolist(), ranges.tolist(), strict=True):
                if p != last:
                    last, grams = p, {}
                    passage = tokens[3 * lists.longest * p :][: 4 * lists.longest].tolist()
                    terms = set(passage)
                for row, score in lists.search(terms, r):
                    overlaps = []
                    for n, part in lists.items[row].parts:
                        if n and n not in grams:
                            grams[n] = _grams(passage, n)
                        overlaps.append(len(part & grams[n]) / len(part) if n else 1.0)
                    if overlaps[0] >= QUESTION and overlaps[1] >= ANSWER:
                        best[row] = max(best.get(row, (0.0, 0.0, 0.0)), (score, *overlaps))
            out += [(lists.items[row].item_id, *x) for row, x in best.items()]
        return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))


FOUND = "array<struct<item_id: bigint, score: double, question: double, answer: double>>"


class Parts:
    """A table of test items as indexes of bounded size, one at a time on the driver."""

    def __init__(self, items: DataFrame, count: int):
        self.items, self.count = items, count

    def __iter__(self):
        for i in range(self.count):
            rows = self.items.where(F.pmod(F.xxhash64("id", "text"), F.lit(self.count)) == i) if self.count > 1 else self.items
            yield Index([tuple(r) for r in rows.collect()])


def build_index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", part_items: int = PART_ITEMS, part_bytes: int = PART_BYTES) -> Parts:
    """The items, counted and measured, in as many parts as their number and bytes ask for."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    return Parts(items, max(1, math.ceil(size["n"] / part_items), math.ceil(size["bytes"] / part_bytes)))


def with_items(df: DataFrame, parts: Parts, text_col: str = "text", out: str = "items") -> DataFrame:
    """df with the test items found in each text: an array of item_id, score (in thresholds), question and answer overlap."""
    spark = df.sparkSession
    ready(spark)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    def finder(index: Index):
        held = spark.sparkContext.broadcast(index)

        @F.arrow_udf(FOUND)
        def find(texts: pa.Array) -> pa.Array:
            names = ("item_id", "score", "question", "answer")
            return pa.array([[dict(zip(names, x, strict=True)) for x in held.value.contained(t.as_py())] for t in texts], kind)

        return find(F.col(text_col))

    if parts.count == 1:
        return df.withColumn(out, finder(next(iter(parts))))
    found = unused(df, "found")[0]
    rows = df.withColumn(found, F.array().cast(FOUND))
    for index in parts:
        rows = stored(spark, rows.withColumn(found, F.concat(found, finder(index))), "found")
    return rows.withColumn(out, F.array_sort(found)).select(*[c for c in df.columns if c != out], out)

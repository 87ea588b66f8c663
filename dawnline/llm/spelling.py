"""Spelling variants: words that differ by one letter, found by probing generated edits against broadcast Bloom filters.

1. Words of all texts are counted, in tasks first, then by a shuffle of the counts.
2. The vocabulary goes into split-block Bloom filters, sharded by word length (lengths of LONGEST and more share a shard).
   A shard's blocks are set up by a distributed bit_or; shards are cut into slices by hash, of at most SLICE_BYTES each.
3. Each word generates its neighbourhood: all deletions of a letter, and replacements of a letter by a later one of the
   alphabet. That is each near pair once: an insertion is the deletion seen from the other word. Edits are probed as hashes
   (a sum over the letters, so that an edit costs two terms and no string), against the shard of their length only.
   Filters are broadcast in rounds of at most ROUND_BYTES, whatever the size of the vocabulary.
4. Only positives are shuffled: names of word and edit, 128 bits each, to an exact join with the vocabulary; levenshtein() = 1
   of the joined words confirms every pair, so that neither filters nor names can add one, and none can be lost.

A word's form is its near word of largest count (ties: smallest in code-point order), if that count is at least RATIO times
its own; its root is where the chain of forms ends. Counts grow tenfold along a chain, so doubling its steps reaches every
end within five rounds.

Defined results: a null or empty text has no words; a very long text is read in slices that cut no word, a very long word is
one word, whose edits are probed in blocks of CELLS; repeated rows count again, as does each row of a repeated doc_id; a null
doc_id counts as an empty one in the hash that deletes letters. Extra columns of any name are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnline.llm.shared import ready, stored, word_slices

SHORTEST, RATIO, LONGEST = 7, 10, 40
KEY_BITS, SLICE_BYTES, ROUND_BYTES = 24, 8 << 20, 64 << 20
CELLS, COUNTED = 1 << 18, 100_000
#: The letters of words, as Latin-1: A-Z as a-z, and U+00C0 to U+00FF; all else parts words.
LETTERS = bytes(range(0x61, 0x7B)) + bytes(range(0xC0, 0x100))
_LOWERED = bytes(c if c in LETTERS else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


def _terms(places: np.ndarray, letters: np.ndarray, seed: np.uint64) -> np.ndarray:
    """What a letter at a place adds to the name of its word."""
    return _mixed((places.astype(np.uint64) * np.uint64(256) + letters.astype(np.uint64) + np.uint64(1)) * seed)


def noisy(run: bytes, prefix: int) -> bytes:
    """The run (Latin-1), without the letter at crc32 % length where 31 divides the crc32 of prefix and run."""
    crc = zlib.crc32(run.decode("latin-1").encode(), prefix)
    if crc % 31:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[bytes, int], bytes] | None = None, shortest: int = SHORTEST, least: int = 2) -> DataFrame:
    """word and n of the words of at least shortest letters that occur at least least times in all texts.

    change(word, crc32 of "<id>:") gives the word that counts in a row; by default the word itself.
    """
    ready(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                prefix, own = zlib.crc32(f"{key.as_py() if key.is_valid else ''}:".encode()), Counter()
                # what Latin-1 lacks becomes a question mark, which parts words like any other
                for words in word_slices((text.as_py() or "").encode("latin-1", "replace").translate(_LOWERED)):
                    own.update(words)
                for word, n in own.items():
                    if len(word) >= shortest:
                        if change is not None:
                            word = change(word, prefix)
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) > COUNTED:
                    yield told()
        if held:
            yield told()

    found = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words, letters as a matrix) of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield at, np.frombuffer("".join(words[i] for i in at).encode("latin-1"), np.uint8).reshape(len(at), length)


def _names(letters: np.ndarray, seed: np.uint64) -> np.ndarray:
    return _terms(np.arange(letters.shape[1]), letters, seed).sum(axis=1, dtype=np.uint64)


def named(words: DataFrame) -> DataFrame:
    """words (word, n) with a and b, the word's 128-bit name, and shard, its length or LONGEST."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            a, b, shard = np.zeros(len(values), np.uint64), np.zeros(len(values), np.uint64), np.zeros(len(values), np.int32)
            for at, letters in _by_length(values):
                a[at], b[at], shard[at] = _names(letters, _P), _names(letters, _R), min(letters.shape[1], LONGEST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(shard)], names=["word", "n", "a", "b", "shard"])

    return words.select("word", "n").mapInArrow(name, "word string, n long, a long, b long, shard int")


def _slice_and_block(a: np.ndarray, slices: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mixed(a)
    return (x & np.uint64(0xFFFFF)) % np.uint64(slices), ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _bits(a: np.ndarray) -> np.ndarray:
    return _mixed(a * _R + _Q)


def _lane(bits: np.ndarray, i: int) -> np.ndarray:
    """The two bits, one in each half, that a name sets in the i-th 64-bit word of its block."""
    low, high = (bits >> np.uint64(10 * i)) & np.uint64(31), (bits >> np.uint64(10 * i + 5)) & np.uint64(31)
    return (np.uint64(1) << low) | (np.uint64(1) << (high + np.uint64(32)))


class Shards:
    """Sizes of the filters: the slices of each shard and the blocks (of 32 bytes) of each slice."""

    def __init__(self, counts: dict[int, int]):
        self.sizes = {}
        for shard, n in counts.items():
            blocks = max(1, -(-n * KEY_BITS // 256))
            slices = -(-blocks * 32 // SLICE_BYTES)
            self.sizes[shard] = (slices, -(-blocks // slices))

    def rounds(self) -> Iterator[dict[tuple[int, int], int]]:
        """The place of the first block of each (shard, slice), for as many of them as fit into one broadcast."""
        held, used = {}, 0
        for shard, (slices, blocks) in self.sizes.items():
            for i in range(slices):
                if used and (used + blocks) * 32 > ROUND_BYTES:
                    yield held
                    held, used = {}, 0
                held[shard, i] = used
                used += blocks
        if held:
            yield held


def filter_blocks(vocabulary: DataFrame, shards: Shards) -> DataFrame:
    """The set blocks of the filters: shard, slice, block and their four 64-bit words."""
    sizes = shards.sizes

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, a = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            part, block = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
            for s in np.unique(shard).tolist():
                at = shard == s
                part[at], block[at] = _slice_and_block(a[at], *sizes[s])
            columns = [batch.column(0), pa.array(part), pa.array(block), *(pa.array(_lane(_bits(a), i).view(np.int64)) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "slice", "block", "w0", "w1", "w2", "w3"])

    rows = vocabulary.select("shard", "a").mapInArrow(bits, "shard int, slice int, block int, w0 long, w1 long, w2 long, w3 long")
    return rows.groupBy("shard", "slice", "block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


class Prober:
    """Generates the edits of words and keeps those that the filters of one round may hold."""

    def __init__(self, held: dict[tuple[int, int], int], sizes: dict[int, tuple[int, int]], blocks: np.ndarray, alphabet: bytes):
        self.sizes, self.blocks, self.alphabet = sizes, blocks, np.frombuffer(alphabet, np.uint8)
        self.starts = {s: np.array([held.get((s, i), -1) for i in range(n)], np.int64) for s, (n, _) in sizes.items()}

    def maybe(self, a: np.ndarray, shard: int) -> np.ndarray:
        """The places of the names that this round's filters may hold."""
        if not self.probes(shard):
            return np.zeros(0, np.int64)
        part, block = _slice_and_block(a, *self.sizes[shard])
        start = self.starts[shard][part.astype(np.int64)]
        at = np.flatnonzero(start >= 0)
        block, bits = start[at] + block[at].astype(np.int64), _bits(a[at])
        for i in range(4):
            lane = _lane(bits, i)
            hit = self.blocks[block, i] & lane == lane
            at, block, bits = at[hit], block[hit], bits[hit]
        return at

    def probes(self, shard: int) -> bool:
        return shard in self.starts and bool((self.starts[shard] >= 0).any())

    def edits(self, letters: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, name a, name b) of the positive edits of words of one length: rows of letters, with names a and b."""
        length = letters.shape[1]
        if self.probes(min(length, LONGEST)):
            step = max(1, CELLS // len(self.alphabet))
            for start in range(0, letters.size, step):
                flat = np.arange(start, min(start + step, letters.size))
                old = letters.reshape(-1)[flat]
                i, j = np.nonzero(self.alphabet > old[:, None])
                row, place, new = flat[i] // length, flat[i] % length, self.alphabet[j]
                made = a[row] - _terms(place, old[i], _P) + _terms(place, new, _P)
                hit = self.maybe(made, min(length, LONGEST))
                row, place, new, old = row[hit], place[hit], new[hit], old[i[hit]]
                yield row, made[hit], b[row] - _terms(place, old, _R) + _terms(place, new, _R)
        if self.probes(min(length - 1, LONGEST)):
            step = max(1, CELLS // length)
            for start in range(0, len(letters), step):
                part = letters[start : start + step]
                # of equal letters in a row, the first stands for all
                row, place = np.nonzero(np.concatenate([np.ones((len(part), 1), dtype=bool), part[:, 1:] != part[:, :-1]], axis=1))
                made = [self._without(part, seed)[row, place] for seed in (_P, _R)]
                hit = self.maybe(made[0], min(length - 1, LONGEST))
                yield row[hit] + start, made[0][hit], made[1][hit]

    @staticmethod
    def _without(letters: np.ndarray, seed: np.uint64) -> np.ndarray:
        """The names of the words without the letter at each place."""
        places = np.arange(letters.shape[1])
        own = np.broadcast_to(_terms(places, letters, seed), letters.shape)
        before = np.cumsum(own, axis=1, dtype=np.uint64) - own
        moved = np.zeros(letters.shape, np.uint64)  # what each letter adds one place further left
        moved[:, 1:] = _terms(places[:-1], letters[:, 1:], seed)
        after = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
        return before + after


def _positives(vocabulary: DataFrame, prober: Callable[[], Prober]) -> DataFrame:
    """Names of words (a, b) and of their edits (near_a, near_b) that the filters may hold."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = prober()
        for batch in batches:
            a, b = (batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))
            for at, letters in _by_length(batch.column(0).to_pylist()):
                for row, near_a, near_b in own.edits(letters, a[at], b[at]):
                    if len(row):
                        columns = (a[at][row], b[at][row], near_a, near_b)
                        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["a", "b", "near_a", "near_b"])

    return vocabulary.select("word", "a", "b").mapInArrow(probe, "a long, b long, near_a long, near_b long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n of the pairs of named words that differ by one inserted, deleted or replaced letter, each once."""
    spark = vocabulary.sparkSession
    shards = Shards({r["shard"]: r["count"] for r in vocabulary.groupBy("shard").count().collect()})  # at most LONGEST rows
    used = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").distinct()
    alphabet = bytes(sorted(r["letter"].encode("latin-1")[0] for r in used.collect()))  # at most LETTERS
    blocks = stored(spark, filter_blocks(vocabulary, shards), "filters")
    found = spark.createDataFrame([], "a long, b long, near_a long, near_b long")
    for held in shards.rounds():
        array = np.zeros((sum(shards.sizes[s][1] for s, _ in held), 4), np.uint64)
        first, last = {}, {}
        for s, i in held:
            first[s], last[s] = min(first.get(s, i), i), max(last.get(s, i), i)
        table = blocks.where(" or ".join(f"shard = {s} and slice between {first[s]} and {last[s]}" for s in first)).toArrow()
        columns = [table[c].to_numpy() for c in ("shard", "slice", "block")]
        if len(columns[0]):
            start = np.array([held[s, i] for s, i in zip(columns[0].tolist(), columns[1].tolist(), strict=True)])
            array[start + columns[2]] = np.stack([table[f"w{i}"].to_numpy().view(np.uint64) for i in range(4)], axis=1)
        shared = spark.sparkContext.broadcast(array)  # at most ROUND_BYTES, or one slice
        sizes = shards.sizes
        found = found.union(stored(spark, _positives(vocabulary, lambda held=held, shared=shared: Prober(held, sizes, shared.value, alphabet)), "positives"))
        shared.unpersist()
    near = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("a").alias("near_a"), F.col("b").alias("near_b"))
    # the false ones go with the first join; the words come back with the second
    pairs = found.join(near, ["near_a", "near_b"]).join(vocabulary.select("word", "n", "a", "b"), ["a", "b"])
    return pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root, the end of its chain, of forms (word, form)."""
    spark = forms.sparkSession
    links = stored(spark, forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nexts = links.select(F.col("word").alias("root"), F.col("root").alias("after"))
        links = stored(spark, links.join(nexts, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def grouped_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, form, form_n, root and n_near of each word of counts (word of LETTERS, n)."""
    spark = counts.sparkSession
    vocabulary = stored(spark, named(counts), "vocabulary")
    pairs = stored(spark, near_pairs(vocabulary), "pairs")
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    # the largest count first, then the smallest word: strings are compared by UTF-8, which is code-point order
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    big = -F.col("best.minus") >= ratio * F.col("n")
    forms = vocabulary.select("word", "n").join(near, "word", "left").select("word", "n", F.when(big, F.col("best.near")).alias("form"), F.when(big, -F.col("best.minus")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
    forms = stored(spark, forms, "forms")
    return forms.join(_roots(forms.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))

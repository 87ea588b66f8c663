"""Token counts of a sentencepiece BPE model, by dynamic programming over prefixes.

No piece of such a model has a word mark after another character, so a text falls into segments (a run of marks and
the characters up to the next run) that are tokenised on their own. Within a segment, each prefix has exactly one last
token: the one that begins where a prefix ends whose own last token may stand before it. The table of these last tokens
gives the exact token count of every prefix in one pass; truncation and budget questions are answered from the counts,
without encoding anything again. A character outside the vocabulary counts as its UTF-8 bytes (byte fallback).

Defined results: null or empty text has 0 tokens; a very long text is counted whole, a segment at a time, and what a worker
remembers of segments is bounded by bytes, long ones not being kept; repeated rows are counted one by one; an empty table
gives no rows; other columns pass unchanged and an existing column named like the output is replaced.
"""

from __future__ import annotations


import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnline.llm.shared import Memo, held, ready

MARK = "▁"
_SEGMENTS = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall


class PrefixCounter:
    """Token counts at every prefix, for a BPE model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("pieces with inner word marks: segments would not be independent")
        self.trie = ahocorasick.Automaton()
        for piece in self.scores:
            self.trie.add_word(piece, len(piece))
        self.trie.make_automaton()
        self.fits = Memo(self._fits)
        self.totals = Memo(lambda segment: self.prefixes(segment)[-1])
        self.words = Memo(lambda word: self.totals[MARK + word])

    def _fits(self, pair: tuple[str, str]) -> bool:
        parts = list(pair[0] + pair[1])
        while len(parts) > 1:
            found = [(-self.scores[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts == list(pair)

    def prefixes(self, segment: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, ... characters."""
        counts, last = [0] * (len(segment) + 1), [""] * (len(segment) + 1)
        ends: list[list[int]] = [[] for _ in segment]
        for end, length in self.trie.iter(segment):
            ends[end].append(length)
        for end, lengths in enumerate(ends, 1):
            for length in lengths:
                start, token = end - length, segment[end - length : end]
                if start == 0 or self.fits[last[start], token]:
                    counts[end], last[end] = counts[start] + 1, token
                    break
            else:  # not in the vocabulary: its bytes
                char = segment[end - 1]
                counts[end], last[end] = counts[end - 1] + len(char.encode("utf-8")), char
        return counts

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.words.__getitem__, text.split(" ")))
        return sum(map(self.totals.__getitem__, _SEGMENTS(MARK + text.replace(" ", MARK))))

    def table(self, text: str) -> np.ndarray:
        """Counts of text[:0], text[:1], ...; the empty prefix has none."""
        if not text:
            return np.zeros(1, dtype=np.int32)
        out, before = [], 0
        for segment in _SEGMENTS(MARK + text.replace(" ", MARK)):
            counts = self.prefixes(segment)
            out += [before + c for c in counts[1:]]
            before += counts[-1]
        out[0] = 0  # the dummy prefix alone
        return np.array(out, dtype=np.int32)


def counter(path: str) -> PrefixCounter:
    return held(PrefixCounter, path)


def token_count(text: Column | str, path: str) -> Column:
    """long: the exact number of tokens of the whole text."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        c = counter(path)
        return pa.array([c.count(t.as_py() or "") for t in texts], type=pa.int64())

    return count(text)


def prefix_counts(text: Column | str, path: str) -> Column:
    """array<int>: the token counts of the text's prefixes of 0, 1, ... characters."""

    @F.arrow_udf("array<int>")
    def table(texts: pa.Array) -> pa.Array:
        c = counter(path)
        return pa.array([c.table(t.as_py() or "").tolist() for t in texts], type=pa.list_(pa.int32()))

    return table(text)


def fitting_chars(text: Column | str, budget: int, path: str) -> Column:
    """int: the length of the longest prefix with at most budget tokens."""

    @F.arrow_udf("int")
    def fit(texts: pa.Array) -> pa.Array:
        c = counter(path)
        return pa.array([int(np.flatnonzero(c.table(t.as_py() or "") <= budget)[-1]) for t in texts], type=pa.int32())

    return fit(text)


def budget_cuts(counts: list[int], budget: int) -> list[int]:
    """Greedy cuts of a text into runs of counted units (their counts given) of at most budget tokens; larger units stand alone."""
    cuts, used = [], 0
    for i, n in enumerate(counts):
        if i and used + n > budget:
            cuts.append(i)
            used = 0
        used += n
    return cuts


def with_token_counts(df: DataFrame, path: str, limit: int, text_col: str = "text") -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    ready(df.sparkSession)
    return df.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "n_tokens": token_count(F.col(text_col), path)}
    ).withColumn("over_limit", F.col("n_tokens") > limit)

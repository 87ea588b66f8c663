"""Byte-level BPE encoding and decoding.

A text is split by the vocabulary's pattern, and each match is encoded on its own, as UTF-8 bytes seen as Latin-1
characters. An Aho-Corasick automaton over all tokens gives the longest token at each byte; the encoder walks from
longest matches and steps back to shorter tokens wherever two neighbours could not both come out of the merges.
Whether two tokens may stand side by side depends on the two alone and is memoised. A position that was given up is
never tried again, so the work is linear in the length of the match.

Defined results: null or empty text has no ids and decodes to no bytes; a very long text is encoded whole, a match at a
time, and what a worker remembers of matches is bounded by bytes, long ones not being kept; repeated rows and repeated ids
are encoded one by one; an empty table gives no rows; rows and other columns pass unchanged, and an existing column named
like the output is replaced.
"""

from __future__ import annotations

import base64

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnline.llm.shared import CACHE_BYTES, Memo, held, ready

#: A fixed value: the public pattern whose matches hold a space at their start only, so that a single space between
#: other characters always begins a match and words can be looked up whole.
LEADING_SPACE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE_SPACE = regex.compile(r"^ | $| \s|\s ").search


def merged(data: str, ranks: dict[str, int]) -> list[str]:
    """The merges by rank, lowest first and leftmost on ties, on a short string; the definition that pairs are tested by."""
    parts = list(data)
    while len(parts) > 1:
        found = [(ranks[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in ranks]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Codec:
    """Encoder and decoder for a file of base64 tokens and ranks; each of its four caches holds cache_bytes at most."""

    def __init__(self, path: str, pattern: str, cache_bytes: int = CACHE_BYTES):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern = pattern
        self.split = regex.compile(pattern).findall
        self.trie = ahocorasick.Automaton()
        for token in self.ranks:
            self.trie.add_word(token, token)
        self.trie.make_automaton()
        self.bytes = {i: t.encode("latin-1") for t, i in self.ranks.items()}
        self.shorter = Memo(self._shorter, cache_bytes)
        self.fits = Memo(self._fits, cache_bytes)
        self.ids = Memo(self._ids, cache_bytes)
        self.words = Memo(self._word, cache_bytes)

    def _shorter(self, token: str) -> str | None:
        return next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)

    def _fits(self, pair: tuple[str, str]) -> bool:
        return merged(pair[0] + pair[1], self.ranks) == list(pair)

    def tokens(self, data: str) -> list[str]:
        """The tokens of one match, given as Latin-1."""
        if data in self.ranks:
            return [data]
        longest: list = [None] * len(data)
        for end, token in self.trie.iter(data):
            longest[end + 1 - len(token)] = token  # later matches from a start are longer
        out: list[str] = []
        dead = bytearray(len(data) + 1)  # positions from which no way leads on
        at, token = 0, longest[0]
        while at < len(data):
            while token is not None and (dead[at + len(token)] or (out and not self.fits[out[-1], token])):
                token = self.shorter[token]
            if token is None:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes of this text")
                dead[at] = 1
                token = out.pop()
                at -= len(token)
            else:
                out.append(token)
                at += len(token)
                token = longest[at] if at < len(data) else None
        return out

    def _ids(self, piece: str) -> bytes:
        ids = [self.ranks[t] for t in self.tokens(piece.encode("utf-8").decode("latin-1"))]
        return np.array(ids, dtype="<i4").tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.split(" " + word)))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<i4")
        if self.pattern == LEADING_SPACE_PATTERN and not _WIDE_SPACE(text):
            first, *rest = text.split(" ")
            parts = [*map(self.ids.__getitem__, self.split(first)), *map(self.words.__getitem__, rest)]
        else:
            parts = map(self.ids.__getitem__, self.split(text))
        return np.frombuffer(b"".join(parts), dtype="<i4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def codec(path: str, pattern: str, cache_bytes: int = CACHE_BYTES) -> Codec:
    return held(Codec, path, pattern, cache_bytes)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))


def encode_column(text: Column | str, path: str, pattern: str) -> Column:
    """array<int>: the ids of each text."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        code = codec(path, pattern)
        return _lists([code.encode(t.as_py() or "") for t in texts])

    return encode(text)


def decode_column(ids: Column | str, path: str, pattern: str) -> Column:
    """binary: the bytes that each list of ids stands for; a null list stands for none."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        code = codec(path, pattern)
        return pa.array([code.decode(x.as_py() or ()) for x in lists], type=pa.binary())

    return decode(ids)


def encode_and_decode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "bpe", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """df with a struct of ids (array<int>) and decoded (binary), both made in one pass over the text; results don't depend on cache_bytes."""
    ready(df.sparkSession)

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(texts: pa.Array) -> pa.Array:
        code = codec(path, pattern, cache_bytes)
        ids = [code.encode(t.as_py() or "") for t in texts]
        decoded = pa.array([code.decode(x.tolist()) for x in ids], type=pa.binary())
        return pa.StructArray.from_arrays([_lists(ids), decoded], ["ids", "decoded"])

    return df.withColumn(out, both(F.col(text_col)))


def digests(df: DataFrame, id_col: str = "doc_id", out: str = "bpe") -> DataFrame:
    """What a round trip can be compared by: n_tokens, ids_sha256 and decoded_sha256 of encode_and_decode()'s struct."""
    ids, decoded = F.col(f"{out}.ids"), F.col(f"{out}.decoded")
    return df.select(
        id_col,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )

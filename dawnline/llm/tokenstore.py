"""Token ids in sorted-string-table shards.

A shard holds documents ordered by identifier: packed data blocks with prefix-compressed keys, a sparse index of the blocks'
last keys, a Bloom filter over the keys, and a fixed-size footer. lookup() finds a document by one filter probe, one
binary search in the index and the reading of one block. Spark range-partitions and sorts the documents, so that shards
are in order among themselves; each task encodes and writes its own range, block by block, and leaves one manifest row
per shard. A shard appears under its name by a rename after it is complete, and its content depends on its rows only,
so a task that runs again after a lost executor replaces it by the same bytes.

Keys are 21 bytes: 0 for a null identifier or 1, the identifier (big-endian, sign bit flipped), the hash of the text in
the same form, a number that tells equal rows apart. Ranges are cut by identifier and hash, so that rows that share an
identifier, or have none, spread over tasks and shards. Values are little-endian unsigned 32-bit ids.

Defined results: null or empty text is stored with its end id alone; null identifiers come first; rows that share an
identifier are all kept, ordered by their texts' hashes, and equal rows as often as they come (equal rows are the only
ones that always meet in one task, which writes them block by block); a very long text is one value, encoded whole, and
a block holds at least one; an empty table gives no shards and an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dawnline.llm.shared import Memo, held, ready, shared_path

# tasks are Spark's parallelism; the library's own threads would compete with them
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

MAGIC = b"dawnsst1"
FOOTER = struct.Struct("<QQQQQQ8s")  # index at, its bytes, filter at, its bytes, documents, ids, magic
KEY = struct.Struct(">BQQI")
PREFIX = struct.Struct(">BQ")
BLOCK_BYTES, SHARD_BYTES, FILTER_BITS, FILTER_PROBES = 64 << 10, 64 << 20, 10, 7
MANIFEST = "path string, first_key binary, docs long, ids long, bytes long"
_SIGN = 1 << 63
_SIGNS = ".,;:!?()[]#$%&*"


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


def prefix(doc_id: int | None) -> bytes:
    """What all keys of an identifier begin with; the Bloom filter holds these."""
    return PREFIX.pack(0, 0) if doc_id is None else PREFIX.pack(1, doc_id + _SIGN)


def pack_key(doc_id: int | None, text_hash: int, number: int) -> bytes:
    return prefix(doc_id) + struct.pack(">QI", text_hash + _SIGN, number)


def unpack_id(key: bytes) -> int | None:
    known, doc_id = PREFIX.unpack_from(key)
    return doc_id - _SIGN if known else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9747B28C) | 1
    return [(a + i * b) % bits for i in range(FILTER_PROBES)]


def _open(path: str):
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, path: str, attempt: int, block_bytes: int = BLOCK_BYTES):
        self.path, self.block_bytes = path, block_bytes
        self.files, self.final = _open(path)
        self.draft = f"{self.final}.draft-{attempt}"
        self.out = self.files.open_output_stream(self.draft)
        self.block, self.index, self.known, self.last, self.at = bytearray(), [], [], b"", 0
        self.first, self.docs, self.ids = b"", 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        same = 0
        if self.block:
            while same < len(key) and key[same] == self.last[same]:
                same += 1
        self.block += _varint(same) + _varint(len(key) - same) + _varint(len(value)) + key[same:] + value
        if not self.docs:
            self.first = key
        start = key[: PREFIX.size]
        if not self.known or self.known[-1] != start:
            self.known.append(start)
        self.last = key
        self.docs += 1
        self.ids += len(value) // 4
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = zstandard.compress(bytes(self.block), 1)
            self.out.write(packed)
            self.index.append((self.last, self.at, len(packed)))
            self.at += len(packed)
            self.block = bytearray()

    def close(self) -> tuple:
        self._flush()
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bits = max(64, FILTER_BITS * len(self.known))
        bloom = bytearray((bits + 7) // 8)
        for key in self.known:
            for p in _probes(key, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        foot = FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, MAGIC)
        self.out.write(index + bytes(bloom) + foot)
        self.out.close()
        self.files.move(self.draft, self.final)
        return self.path, self.first, self.docs, self.ids, self.at + len(index) + len(bloom) + len(foot)


class ShardReader:
    """Reads one shard: single documents by lookup(), all of them, a block at a time, by iteration."""

    def __init__(self, path: str):
        files, name = _open(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        if size < FOOTER.size:
            raise ValueError(f"{path} is no shard")
        at, n, bloom_at, bloom_n, self.docs, self.ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.bloom, raw, self.index = self._read(bloom_at, bloom_n), self._read(at, n), []
        i = 0
        while i < len(raw):
            k = raw[i]
            self.index.append((raw[i + 1 : i + 1 + k], *struct.unpack_from("<QQ", raw, i + 1 + k)))
            i += 17 + k
        self.lasts = [x[0] for x in self.index]

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _block(self, at: int, n: int) -> Iterator[tuple[bytes, bytes]]:
        raw, i, key = zstandard.decompress(self._read(at, n)), 0, b""
        while i < len(raw):
            sizes = []
            for _ in range(3):
                x = shift = 0
                while True:
                    byte = raw[i]
                    i += 1
                    x |= (byte & 127) << shift
                    shift += 7
                    if byte < 128:
                        break
                sizes.append(x)
            same, rest, value = sizes
            key = key[:same] + raw[i : i + rest]
            yield key, raw[i + rest : i + rest + value]
            i += rest + value

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, n in self.index:
            yield from self._block(at, n)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of this identifier in the shard."""
        key, found = prefix(doc_id), []
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8)):
            return found
        for _, at, n in self.index[bisect.bisect_left(self.lasts, key) :]:
            for k, v in self._block(at, n):
                if k.startswith(key):
                    found.append(np.frombuffer(v, dtype="<u4"))
                elif k > key:
                    return found
        return found

    def close(self) -> None:
        self.file.close()


class WordEncoder:
    """Encodes with the tokenizers library; text between spaces is encoded once and remembered.

    Exact where the tokenizer drops white space, splits at it and between letters and signs, and lower-cases, as its
    normalizer and pre-tokenizer here do. A word of letters with signs after it is looked up by its letters, lower-cased
    (but for sigma, whose lower case depends on its place), and a run of Latin letters goes to the library's merges
    without another split; everything else is given to the library as it stands.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model
        self.parts = Memo(self._part, 96 << 20)
        self.words = Memo(self._word, 128 << 20)

    def _part(self, part: str) -> bytes:
        if part.isalpha() and max(part) < "\u0250" and part == part.lower():  # one run of Latin letters, which no normalization changes
            ids = [token.id for token in self.merges.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_LETTERS))]
        else:
            ids = self.library.encode(part, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        low = word.lower()
        letters = low.rstrip(_SIGNS)
        if letters.isalpha() and "\u03a3" not in word:
            signs = low[len(letters) :]
            return self.parts[letters] + self.parts[signs] if signs else self.parts[letters]
        return self.parts[word] if word else b""

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> WordEncoder:
    return held(WordEncoder, path)


def write_shards(df: DataFrame, tokenizer_path: str, end_id: int, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and store df's texts below root (a URI that all executors reach); the manifest, in shard order, as a table."""
    spark = df.sparkSession
    ready(spark)
    root = root or shared_path(spark, "tokens")
    files, name = _open(root)
    files.create_dir(name, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer_path).encode, TaskContext.get()
        end = struct.pack("<I", end_id)
        shard, rows, n, before, number = None, [], 0, None, 0

        def done():
            rows.append(shard.close())

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, text in zip(keys, batch.column(2), strict=True):
                number = number + 1 if key == before else 0
                before = key
                if shard is not None and shard.at >= SHARD_BYTES:
                    done()
                    shard = None
                if shard is None:
                    shard = ShardWriter(f"{root}/shard-{task.partitionId():06d}-{n:04d}.sst", task.taskAttemptId(), BLOCK_BYTES)
                    n += 1
                shard.add(pack_key(*key, number), encode(text.as_py() or "") + end)
        if shard is not None:
            done()
        names = ["path", "first_key", "docs", "ids", "bytes"]
        types = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)

    columns = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    columns = columns.select("id", F.xxhash64("text").alias("hash"), "text")
    # nulls sort first in Spark as in the keys
    ordered = columns.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every stored document: doc_id, start (ids of all documents before it) and its ids (unsigned 32-bit, as bytes)."""
    spark: SparkSession = manifest.sparkSession
    ready(spark)
    # one short row per shard: the running sum over them is small at any size of the corpus
    before = Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "ids"])

        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, rows, held = ShardReader(path), [], 0
                for key, value in shard:
                    rows.append((unpack_id(key), start, value))
                    start += len(value) // 4
                    held += len(value)
                    if held > 4 << 20:
                        yield out(rows)
                        rows, held = [], 0
                shard.close()
                if rows:
                    yield out(rows)

    # a given number of tasks, which are not merged again: up to 16 shards each once there are enough for all
    shards = manifest.count()
    tasks = max(1, min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 16)))
    return starts.repartition(tasks).mapInArrow(read, "doc_id long, start long, ids binary")

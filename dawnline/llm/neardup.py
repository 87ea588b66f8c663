"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

A document is the set of its distinct word shingles, as 64-bit hashes. One hash gives all signature values: its top bits
choose the bin, and each bin keeps its smallest hash; an empty bin borrows from the first non-empty one in a fixed random
order of its own (optimal densification). Documents with equal sets are one node. Four bins make a band, and nodes that
agree on a band share a bucket. Then, in two steps:

1. In each bucket every node is paired with the smallest only (a star), so pairs grow with the rows and not with their
   squares. Pairs that the signatures don't rule out are confirmed on the full sets, and links are joined to components.
2. What a star can miss is a link between nodes of one bucket that are in different components after step 1. In a bucket
   of at most BLOCK members all such pairs are compared by signature, inside the task. The members of larger buckets are
   dealt anew, by the exact prefix filter: with a set's shingles in order from the rarest on, two sets within the threshold
   share one of the first n - ceil(t * n) + 1 of each. Pages of one template, say, that share a bucket by their common
   part have no rare shingle in common and don't meet again; what meets is compared like the rest, the members outside of
   a group's largest component against every member, in blocks. Only pairs within reach of the threshold are confirmed.

So within the buckets no link between components is lost; a pair at Jaccard 0.85 shares none of 16 buckets with a
probability of 7e-6, one at 0.8 none of 24 with 3e-6, and signatures rule out pairs only at 4.5 standard errors below the
threshold. A second filter is exact: each set also has a bitmap with one bit per hash; the common bits, and the hashes that
share a bit within the set, bound the intersection from above.

Defined results: a document without words has an empty set and is linked with nothing; one with fewer words than a
shingle is the whole sequence as one shingle; a very long text is one set of all its shingles, never cut; a null identifier can't be named, so such rows are kept, with a null
component; rows with one identifier are one document of the graph; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnline.llm.shared import forget, grouped, ready, stored
from dawnline.operators.graph import components

BINS, BANDS, ROWS = 256, 16, 4
BLOCK = 512
BITS = 4096
SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary, bits binary"
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
_TRIES = np.random.default_rng(9).integers(0, BINS, (BINS, 4 * BINS))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(29))) * _P + hashes[i : len(words) - size + 1 + i]
    return np.unique(_mixed(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin of a non-empty set, empty bins filled."""
    at = np.searchsorted(hashes, _EDGES)
    full = np.diff(np.append(at, len(hashes))) > 0
    out = hashes[np.minimum(at, len(hashes) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        tried = _TRIES[empty]
        hit = full[tried]
        first = tried[np.arange(len(empty)), hit.argmax(axis=1)]
        out[empty] = out[np.where(hit.any(axis=1), first, np.flatnonzero(full)[0])]
    return out


def bands(sig: np.ndarray, count: int = BANDS) -> np.ndarray:
    keys = np.arange(1, count + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = _mixed(keys * _P + sig[i : count * ROWS : ROWS])
    return keys


def signed(df: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", count: int = BANDS) -> DataFrame:
    """Each document's set size, set key (a 128-bit hash of the set), band keys and 8-bit signature; nulls for an empty set."""
    ready(df.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sizes, keys, band_keys, sigs, bitmaps = [], [], [], [], []
            for text in batch.column(1):
                hashes = shingle_set(text.as_py(), k)
                sizes.append(len(hashes))
                if len(hashes):
                    sig = signature(hashes)
                    keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    band_keys.append(bands(sig, count).view(np.int64))
                    sigs.append(_mixed(sig).astype(np.uint8).tobytes())
                    bits = np.zeros(BITS, dtype=bool)
                    bits[hashes & np.uint64(BITS - 1)] = True
                    bitmaps.append(np.packbits(bits).tobytes())
                else:
                    keys.append(None)
                    band_keys.append(None)
                    sigs.append(None)
                    bitmaps.append(None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(band_keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(bitmaps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "bands", "sig", "bits"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sign, SIGNED)


def _sets(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], names=["set_key", "hashes"])

    return df.select(text_col).mapInArrow(make, "set_key binary, hashes binary")


def _reach(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Equal bins (of BINS) under which a pair of sets of n and m shingles is ruled out."""
    t = percent / 100
    error = np.sqrt(t * (1 - t) / np.minimum(BINS, np.maximum(n, m)))
    return np.where(100 * np.minimum(n, m) < percent * np.maximum(n, m), BINS + 1, np.floor((t - 4.5 * error) * BINS))


def _rows(c: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = c.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _common(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether bitmaps x and y of sets of n and m hashes leave room for 100 * intersection >= percent * union."""
    lost = np.minimum(n - np.bitwise_count(x).sum(axis=-1, dtype=np.int64), m - np.bitwise_count(y).sum(axis=-1, dtype=np.int64))
    most = np.bitwise_count(x & y).sum(axis=-1, dtype=np.int64) + lost
    return 100 * most >= percent * (n + m - most)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, a_key, b_key) whose full sets have 100 * intersection >= percent * union."""

    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
            same = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * same >= percent * (len(p) + len(q) - same))
        return pa.array(out, pa.bool_())

    # the many sides first: a star's hub stands in many pairs, its set is joined last
    joined = pairs.join(sets.select(F.col("set_key").alias("b_key"), F.col("hashes").alias("b_set")), "b_key")
    joined = joined.join(sets.select(F.col("set_key").alias("a_key"), F.col("hashes").alias("a_set")), "a_key")
    return joined.where(near("a_set", "b_set")).select("a", "b")


def star_pairs(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Each bucket's members with its smallest, where the signatures allow a link: a, b, a_key, b_key, distinct."""

    @F.arrow_udf("boolean")
    def possible(n: pa.Array, m: pa.Array, x: pa.Array, y: pa.Array, p: pa.Array, q: pa.Array) -> pa.Array:
        n, m = n.to_numpy(False), m.to_numpy(False)
        return pa.array(((_rows(x) == _rows(y)).sum(axis=1) >= _reach(n, m, percent)) & _common(n, m, _rows(p), _rows(q), percent))

    pairs = members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), F.col("set_key").alias("b_key")).distinct()
    a = nodes.select(F.col("doc_id").alias("a"), F.col("set_key").alias("a_key"), F.col("n_shingles").alias("n"), F.col("sig").alias("x"), F.col("bits").alias("p"))
    b = nodes.select(F.col("set_key").alias("b_key"), F.col("n_shingles").alias("m"), F.col("sig").alias("y"), F.col("bits").alias("q"))
    return pairs.join(b, "b_key").join(a, "a").where(possible("n", "m", "x", "y", "p", "q")).select("a", "b", "a_key", "b_key")


def _mixed_buckets(labelled: DataFrame) -> DataFrame:
    """The rows (bucket, doc_id, set_key, label) of buckets with several components, with size and largest, the biggest one's label."""
    by_label = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("largest")).where("labels > 1")
    # a table, so that the members of a hot bucket are dealt over many tasks
    return labelled.join(stored(labelled.sparkSession, mixed.drop("labels"), "sizes"), "bucket")


def _by_rare_shingle(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rows (doc_id, set_key, label) under each shingle of their prefixes, rarest first, that another row has, too: bucket, doc_id, set_key, label."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.frombuffer(h.as_py(), np.int64) for h in batch.column(1)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["set_key", "items"])

    held = sets.join(rows.select("set_key").distinct(), "set_key", "left_semi").mapInArrow(items, "set_key binary, items array<long>")
    held = stored(rows.sparkSession, held, "items")
    each = held.select("set_key", F.size("items").alias("n"), F.explode("items").alias("item"))
    shared = each.groupBy("item").agg(F.count("*").alias("freq")).where("freq > 1")
    # shingles that no other set has come first in every order; they need no rows, only their number
    known = each.join(shared, "item").groupBy("set_key", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "item"))).alias("common"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1 - (F.col("n") - F.size("common"))
    first = known.where(prefix > 0).select("set_key", F.explode(F.slice("common", F.lit(1), prefix.cast("int"))["item"]).alias("bucket"))
    return first.join(rows, "set_key").select("bucket", "doc_id", "set_key", "label")


def _compared(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs of one bucket of mixed rows, in different components, that the signatures allow: a, b, a_key, b_key."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    columns = ["bucket", "doc_id", "label", "set_key", "largest"]
    held = rows.select(F.pmod(F.xxhash64("set_key", "doc_id"), blocks).cast("int").alias("block"), *columns, F.lit(False).alias("probe"))
    probes = rows.where("label <> largest").select(F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *columns, F.lit(True).alias("probe"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(group: pa.Table) -> pa.RecordBatch | None:
            probe = group["probe"].to_numpy()
            if not probe.any() or probe.all():
                return None
            ids, label, n, largest = (group[c].to_numpy() for c in ("doc_id", "label", "n_shingles", "largest"))
            sig, bits = _rows(group["sig"]), _rows(group["bits"])
            keys = group["set_key"].to_pylist()
            held, found = np.flatnonzero(~probe), []
            for i in np.flatnonzero(probe):
                js = held[(label[held] != label[i]) & ((ids[held] > ids[i]) | (label[held] == largest[i]))]
                js = js[(sig[js] == sig[i]).sum(axis=1) >= _reach(n[js], n[i], percent)]
                if len(js):
                    js = js[_common(n[js], n[i], bits[js], bits[i], percent)]
                found += [(i, j) for j in js]
            if not found:
                return None
            ends = [(i, j) if ids[i] < ids[j] else (j, i) for i, j in found]
            columns = [pa.array([int(ids[i]) for i, _ in ends]), pa.array([int(ids[j]) for _, j in ends]), pa.array([keys[i] for i, _ in ends]), pa.array([keys[j] for _, j in ends])]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "a_key", "b_key"])

        for group in grouped(batches, ["bucket", "block"]):
            if (out := pairs(group)) is not None:
                yield out

    wide = nodes.select("set_key", "doc_id", "n_shingles", "sig", "bits")
    dealt = held.union(probes).join(wide, ["set_key", "doc_id"]).repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(compare, "a long, b long, a_key binary, b_key binary")


def rest_pairs(members: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The pairs of one bucket in different components that the signatures allow, each once: a, b, a_key, b_key."""
    labelled = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", "set_key", F.coalesce("label", "doc_id").alias("label"))
    mixed = stored(members.sparkSession, _mixed_buckets(labelled), "mixed")
    large = mixed.where(F.col("size") > BLOCK).select("doc_id", "set_key", "label").distinct()
    pairs = _compared(mixed.where(F.col("size") <= BLOCK), nodes, percent)
    if not large.isEmpty():
        large = stored(members.sparkSession, large, "large")
        pairs = pairs.union(_compared(_mixed_buckets(_by_rare_shingle(large, sets, percent)), nodes, percent))
    return pairs.distinct()


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", count: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, for each row of df."""
    spark = df.sparkSession
    rows = stored(spark, signed(df, k, id_col, text_col, count), "signed")
    known = rows.where("doc_id is not null and set_key is not null")
    copies = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = known.join(copies.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi").dropDuplicates(["doc_id", "set_key"])

    buckets = reps.select("doc_id", "set_key", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("doc_id").alias("hub")).where("size > 1").select("bucket", "hub")
    # tables of their own before they meet the members again, so that those of a hot bucket are dealt over many tasks
    shared = stored(spark, shared, "hubs")
    members = stored(spark, buckets.join(shared, "bucket"), "members")
    # what is wide is kept once a node, and joined to pairs and blocks when it is needed
    nodes = stored(spark, reps.join(members.select("set_key", "doc_id").distinct().hint("merge"), ["set_key", "doc_id"], "left_semi"), "nodes")

    # a sort-merge join at every size: the ids are a share of the documents, never known to be few
    ids = members.select("doc_id").distinct().hint("merge")
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).join(ids, "doc_id", "left_semi")
    sets = stored(spark, _sets(texts, k, "doc_id", "_text").dropDuplicates(["set_key"]), "sets")

    star = stored(spark, confirmed(star_pairs(members, nodes, percent), sets, percent), "links")
    labels = components(star)
    rest = stored(spark, confirmed(rest_pairs(members, nodes, sets, labels, percent), sets, percent), "links")
    if not rest.isEmpty():
        labels = components(star.union(rest))

    # only texts with copies or links need a name; a table, so that the rows of a much copied text are dealt over many tasks
    named = copies.join(labels.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or label is not null").select("set_key", F.coalesce("label", "rep").alias("component"))
    named = stored(spark, named, "named")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))

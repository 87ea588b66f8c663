"""SimHash groups, filter audits and spelling variants against brute force, and on nulls, repeats, long texts and empty tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from dawnline.llm import audit, queries, simhash, spelling
from dawnline.llm.shared import word_slices
from dawnline.workspace import stored

SF = "/root/testdata/sf0.001"


def texts(spark, values, start=0):
    """Rows with extra columns of names that the operators use inside."""
    rows = [(i + start, t, "keep", 1) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, component int")


def by_hand(text):
    """The fingerprint, hash by hash and bit by bit."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(prints):
    """{id: smallest id linked with it, step by step}; None for a null id."""
    ids = [i for i, _ in prints if i is not None]
    label = {i: i for i in ids}
    near = [(i, j) for (i, x), (j, y) in itertools.combinations([p for p in prints if p[0] is not None], 2) if (x ^ y).bit_count() <= 2]
    while any(label[i] != label[j] for i, j in near):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return label


ODD = ["", None, " \n\t", "One", "one", "one two", "One two three", "ONE TWO THREE", "one two  three\x0b", "ÀB c d", "àb c d", "a b c a b c a b c", "日本 語 🙂 x", "x" * 5000]


def test_fingerprints(spark):
    rng = random.Random(3)
    values = ODD + [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(40))) for _ in range(60)]
    for text in values:
        assert simhash.fingerprint(text) == by_hand(text)
    long = " ".join(rng.choice(["alpha", "Beta", "γ", "delta"]) for _ in range(120_000))  # several slices
    assert len(list(word_slices(long.encode()))) > 2 and simhash.fingerprint(long) == by_hand(long)
    assert [w for part in word_slices(b"ab c\tdd  e ", 3) for w in part] == [b"ab", b"c", b"dd", b"e"]
    assert list(word_slices(b"", 3)) == []


def test_points_are_never_further_than_bits():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**64, 300, dtype=np.uint64)
    turned = fps ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    for x, y in zip(fps, turned, strict=True):
        cells = [set(simhash.grid_cells(np.array([v]))[0].tolist()) for v in (x, y)]
        assert cells[0] & cells[1] and 33 <= len(cells[0]) <= 65


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(8)]
    values = list(ODD)
    for text in base:
        words = text.split()
        for changes in (0, 0, 1, 1, 2, 4):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(99)}"
            values.append(" ".join(copy))
    df = texts(spark, values).union(spark.createDataFrame([(None, base[0], "", 0), (3, "one", "", 0), (900, base[1], "", 0)], "doc_id long, text string, fp string, component int"))
    rows = simhash.near_duplicates(df.repartition(5)).collect()
    want = smallest_reachable([(i, by_hand(t)) for i, t in enumerate(values)] + [(900, by_hand(base[1]))])
    assert len(rows) == len(values) + 3
    for r in rows:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) and r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    assert max(Counter(want.values()).values()) > 3  # near copies are there
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [simhash.BLOCK, 4])
def test_links_of_crowded_cells(spark, block, monkeypatch):
    """Fingerprints around a few centres, and pairs that swap the two bits of a segment, as small cells and as large ones."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3, 5]))}))
        fps |= {(centre & ~0xFFFF) | s for s in (0x5555, 0x5556, 0x555A, 0x5559, 0x6666, 0x9999)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    got = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(stored(spark, nodes, "nodes")).collect()]
    assert len(got) <= 65 * len(fps)  # stars, not pairs

    def groups(pairs):
        label = {f: f for f in fps}
        while any(label[a] != label[b] for a, b in pairs):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert groups(got) == groups([(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2])


def test_group_roots_of_many():
    """A bucket with 16 free bits and more members than are compared pair by pair."""
    rng = np.random.default_rng(2)
    fps = np.unique((rng.integers(0, 2**16, 3000).astype(np.uint64) << np.uint64(24)) | np.uint64(7))
    fps = rng.permutation(fps)[:1500]
    root, label = simhash.group_roots(fps), {}
    near = np.bitwise_count(fps[:, None] ^ fps) <= 2
    for i in range(len(fps)):
        if i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in label:
                    label[j] = i
                    todo += np.flatnonzero(near[j]).tolist()
    assert len({(int(r), label[i]) for i, r in enumerate(root)}) == len(set(root.tolist())) == len(set(label.values()))


def test_path_counts():
    forward, backward = audit.path_counts(5)
    for state in range(32):
        done = state.bit_count()
        assert (forward[state], backward[state]) == (math.factorial(done), math.factorial(5 - done))
    before = [(0, 2), (1, 2)]
    orders = [o for o in itertools.permutations(range(4)) if o.index(0) < o.index(2) and o.index(1) < o.index(2)]
    edges = {(s, x): n for s, x, n in audit.lattice_edges(4, before)}
    taken = Counter((sum(1 << y for y in o[:i]), o[i]) for o in orders for i in range(4))
    assert edges == taken


def audited_by_hand(rows, letters, before=()):
    """{(part, order, step): counts} by running each order over the rows (part, mask, good)."""
    out = {}
    orders = ["".join(o) for o in itertools.permutations(letters)]
    orders = [o for o in orders if all(o.index(a) < o.index(b) for a, b in before)]
    for part in {r[0] for r in rows}:
        own = [({letters[i] for i in range(len(letters)) if m >> i & 1}, g) for p, m, g in rows if p == part]
        shapley = Counter()
        for o in orders:
            left = own
            for step, x in enumerate(o, 1):
                removed = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                redundant = sum(x in f and bool(f & set(o[: step - 1])) for f, _ in own)
                out[part, o, step] = [len(left), len(removed), redundant, sum(f == {x} for f, _ in own), sum(g for _, g in removed)]
                shapley[x] += len(removed)
        for p, o, step in [k for k in out if k[0] == part]:
            out[p, o, step].append(shapley[o[step - 1]])
    return out


@pytest.mark.parametrize("before", [(), [("c", "a")]])
def test_audited(spark, before):
    rng = random.Random(8)
    rows = [(rng.choice(["", "x", "y"]), rng.choice([0, 1, 2, 3, 7, rng.randrange(16)]), rng.random() < 0.4) for _ in range(200)] + [("only", 8, True)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "part string, mask int, good boolean, step string")
    got = audit.audited(df, "abcd", ["good"], before).collect()
    want = audited_by_hand(rows, "abcd", before)
    assert len(got) == len(want)
    for r in got:
        assert [r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["shapley"]] == want[r["part"], r["filter_order"], r["step"]]
    assert audit.audited(df.limit(0), "abcd", ["good"]).collect() == []
    with pytest.raises(ValueError):
        audit.audited(df, "abcdefgh")
    with pytest.raises(ValueError):
        audit.audited(df, "ab", before=[("a", "b"), ("b", "a")])


def test_facts():
    rng = random.Random(2)
    for text in [*ODD, "A#b $ ÀÉ", "".join(rng.choice(" \nAbcÉ#日") for _ in range(3000)), "Ab# " * 200_000]:
        words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        assert audit.facts(text)[:5] == (len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(text or ""), len(re.findall("[#$%&*|]", text or "")))


def test_document_masks(spark):
    docs = spark.createDataFrame([(1, "same", "en", 0), (2, "same", "en", 0), (2, "same", None, 0), (None, "same", "en", 0), (3, "", "en", 0), (4, None, "en", 0), (5, "A" * 9, "en", 0), (5, "A" * 9, "en", 0)], "doc_id long, text string, lang string, repeats int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = audit.document_masks(docs, labels, {"A": "words < 1", "C": "100 * capitals > 3 * points", "E": "repeats"}).collect()
    assert sorted((r["part"], r["mask"], r["good"], r["toxic"]) for r in rows) == sorted([
        ("en", 0, True, True), ("en", 4, False, False), ("", 4, False, False), ("en", 0, False, False), ("en", 1, False, False), ("en", 5, False, False), ("en", 2, False, False), ("en", 2, False, False),
    ])


def variants_by_hand(counts, ratio=10):
    """{word: (n, form, form_n, root, n_near)} over all pairs."""

    def near(x, y):
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        short, long = sorted((x, y), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    form, out = {}, {}
    around = {w: [v for v in counts if near(w, v)] for w in counts}
    for w in counts:
        best = min(around[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], form[w], counts[form[w]] if form[w] else None, root, len(around[w]))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_variants(spark, small, monkeypatch):
    """Also with filters so small that there are many slices and rounds, and many false positives."""
    if small:
        for name, value in (("SLICE_BYTES", 64), ("ROUND_BYTES", 160), ("KEY_BITS", 8)):
            monkeypatch.setattr(spelling, name, value)
    rng = random.Random(6)
    counts = {"zzzzzzz" + "ab"[: i % 3]: 2 * 10**i for i in range(3)} | {"ÿé" * 4 + "abcdefg"[:i]: 3 * 11**i for i in range(7)}
    for _ in range(25):
        word = "".join(rng.choice("abéÿz") for _ in range(rng.choice([7, 8, 9, 12, 60])))
        counts[word] = rng.choice([2, 30, 400, 5000])
        for _ in range(6):
            i, letter = rng.randrange(len(word)), rng.choice("abéÿz")
            made = rng.choice([word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :]])
            counts.setdefault(made, rng.choice([1, 3, 40, 41]))
            word = rng.choice([word, made])
    got = spelling.grouped_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    want = variants_by_hand(counts)
    assert {r["word"]: (r["n"], r["form"], r["form_n"], r["root"], r["n_near"]) for r in got} == want and len(got) == len(want)
    assert len({w for w, x in want.items() if x[1] and want[x[1]][1]}) > 3  # chains


@pytest.mark.parametrize("cells", [spelling.CELLS, 40])
def test_every_edit_is_probed_once(cells, monkeypatch):
    """With filters in which all bits are set; in blocks of any size."""
    monkeypatch.setattr(spelling, "CELLS", cells)
    alphabet = "abcé".encode("latin-1")
    words = ["aabcéba", "ccccccc", "abcabca"]
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(3, 7)
    names = [spelling._names(letters, seed) for seed in (spelling._P, spelling._R)]
    held = {(6, 0): 0, (7, 0): 1}
    prober = spelling.Prober(held, {6: (1, 1), 7: (1, 1)}, np.full((2, 4), 2**64 - 1, np.uint64), alphabet)
    got = [(int(r), int(a), int(b)) for rows, x, y in prober.edits(letters, *names) for r, a, b in zip(rows, x, y, strict=True)]
    want = []
    for i, word in enumerate(words):
        made = {word[:p] + word[p + 1 :] for p in range(7)} | {word[:p] + c + word[p + 1 :] for p in range(7) for c in "abcé" if c > word[p]}
        for w in made:
            one = np.frombuffer(w.encode("latin-1"), np.uint8)[None]
            want.append((i, *(int(spelling._names(one, seed)[0]) for seed in (spelling._P, spelling._R))))
    assert sorted(got) == sorted(want)


def test_word_counts(spark):
    values = [None, "", "Balloons balloons BALLOONS; bal loons", "ÀÉtoiles àÉtoiles étoilesß x", "日本balloons語balloons", "balloonsŁballoons balloo×ns"] + ["longrunofletters " * 30_000]
    df = texts(spark, values)
    want = Counter()
    for text in values:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            want["".join(c.lower() if "A" <= c <= "Z" else c for c in run)] += 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    noisy = Counter()
    for i, text in enumerate(values):
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            noisy[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    assert {r["word"]: r["n"] for r in spelling.word_counts(df, change=spelling.noisy).collect()} == {w: n for w, n in noisy.items() if len(w) >= 7 and n >= 2}
    assert spelling.grouped_variants(spelling.word_counts(df.limit(0))).collect() == []
    # a long word, its copy with one letter less, and rows that repeat
    word = "abcdefg" * 3000
    pair = texts(spark, [word, word, word[:777] + word[778:], word[:777] + word[778:]])
    got = spelling.grouped_variants(spelling.word_counts(pair)).collect()
    assert sorted((len(r["word"]), r["n"], r["n_near"], r["form"]) for r in got) == [(20999, 2, 1, None), (21000, 2, 1, None)]


def test_op11_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = smallest_reachable([(i, by_hand(t)) for i, t in docs.items()])
    df = queries.op11_simhash(spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint", "kept": "boolean"}
    rows = df.collect()
    assert len(rows) == len(docs) and len(set(want.values())) < len(docs)
    for r in rows:
        assert (r["fingerprint"], r["component_id"]) == (f"{by_hand(docs[r['doc_id']]):016x}", want[r["doc_id"]])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, found.fetchall()))

"""Each operator against a brute-force version or the public library, and on nulls, repeats, empty tables and extra columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dawnline.llm import ann, bpe, chat, decontaminate, langid, neardup, tokencount, tokenstore, toxicity, urlfilter
from dawnline.llm.shared import Memo
from dawnline.llm.queries import BYTE_BPE, PIECE_BPE, URL_RULES, WORD_BPE

ODD = ["ŁÓDŹ Straße, ŉ ǅ façade! ÀÈ.", "", None, "   \n\n  x", "日本語 🙂", "a" * 3000, "it's  don't\tx", "<|endoftext|> <s> ▁▁ x", "é ß ﬁ İ ΣΑΣ", " lead", "trail ", "x" * 40 + " y" * 400, "no,signs;here (ok)!"]


def texts(spark, values, start=0):
    """Rows with an extra column for every name that an operator uses inside."""
    rows = [(i + start, t, "keep", 1.0) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, prediction string, score double")


def random_texts(n=300):
    rng = random.Random(4)
    letters = [" ", " ", "\n", "\t", "a", "b", "the", "É", "1", "23", "'s", "!", ",", "▁", "́", "Σ", "日"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_bpe_is_tiktoken_and_goes_back(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    values = ODD + random_texts()
    out = bpe.encode_and_decode(texts(spark, values), BYTE_BPE, public_tokenizers.PATTERN)
    for r in out.collect():
        want = values[r["doc_id"]] or ""
        assert r["bpe"]["ids"] == library.encode_ordinary(want)
        assert bytes(r["bpe"]["decoded"]).decode() == want
        assert r["prediction"] == "keep"
    row = bpe.digests(out).where("doc_id = 3").first()
    ids = library.encode_ordinary(values[3])
    assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode_and_decode(texts(spark, values).limit(0), BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_columns(spark):
    df = texts(spark, ["hello there", None])
    ids = df.select(bpe.encode_column("text", BYTE_BPE, public_tokenizers.PATTERN).alias("ids"))
    assert [bytes(r[0]) for r in ids.select(bpe.decode_column("ids", BYTE_BPE, public_tokenizers.PATTERN)).collect()] == [b"hello there", b""]


def test_token_counts_are_sentencepiece(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    values = ODD + random_texts()
    out = tokencount.with_token_counts(texts(spark, values), PIECE_BPE, 20)
    for r in out.collect():
        text = values[r["doc_id"]] or ""
        n = len(library.encode(text))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 20)
    assert tokencount.with_token_counts(texts(spark, values).limit(0), PIECE_BPE, 20).count() == 0


def test_prefix_counts_and_budgets(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    text = "The quick brown fox, it's  jumping\nover 日本 dogs "
    table = texts(spark, [text]).select(tokencount.prefix_counts("text", PIECE_BPE)).first()[0]
    assert table == [len(library.encode(text[:i])) for i in range(len(text) + 1)]
    fit = texts(spark, [text, None]).select(tokencount.fitting_chars("text", 7, PIECE_BPE)).collect()
    assert fit[0][0] == max(i for i in range(len(text) + 1) if len(library.encode(text[:i])) <= 7) and fit[1][0] == 0
    assert tokencount.budget_cuts([3, 3, 9, 1, 2], 6) == [2, 3]


def test_token_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenstore, "BLOCK_BYTES", 200)
    library = Tokenizer.from_file(WORD_BPE)
    values = ODD + random_texts(120) + ["same", "same"]
    df = texts(spark, values, start=-5)
    df = df.union(df.where("doc_id = 2")).union(texts(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    manifest = tokenstore.write_shards(df, WORD_BPE, end_id=1)
    got = sorted(tokenstore.read_shards(manifest).collect(), key=lambda r: r["start"])
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    want = sorted(((r["doc_id"], r["h"], r["text"] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r["doc_id"] for r in got] == [i for i, _, _ in want]
    start = 0
    for r, (_, _, text) in zip(got, want, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() == ids and r["start"] == start
        start += len(ids)
    shards = [tokenstore.ShardReader(r["path"]) for r in manifest.orderBy("first_key").collect()]
    for i in (-5, 2, None):  # alone, twice, without identifier
        found = [ids.tobytes() for shard in shards for ids in shard.lookup(i)]
        assert found == [bytes(r["ids"]) for r in got if r["doc_id"] == i] and found
    assert not any(shard.lookup(10**12) for shard in shards)
    assert tokenstore.read_shards(tokenstore.write_shards(df.limit(0), WORD_BPE, end_id=1)).count() == 0


def test_store_spreads_one_identifier_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(tokenstore, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(tokenstore, "BLOCK_BYTES", 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = texts(spark, [f"text number {i} of one source" for i in range(3000)]).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.lit(7)))
    manifest = tokenstore.write_shards(df, WORD_BPE, end_id=1).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = {r["path"].split("shard-")[1][:6] for r in manifest}
    assert len(manifest) > 8 and len(tasks) == 4 and sum(r["docs"] for r in manifest) == 3000
    read = tokenstore.read_shards(spark.createDataFrame(manifest, tokenstore.MANIFEST))
    assert read.rdd.getNumPartitions() > 1 and read.where("doc_id = 7").count() == 2000
    starts = sorted((r["start"], r["n"]) for r in read.select("start", (F.octet_length("ids") / 4).cast("long").alias("n")).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_memo_is_bounded_by_bytes():
    memo = Memo(lambda k: k * 2, limit=10_000)
    for i in range(1000):
        assert memo[f"{i}"] == f"{i}" * 2 and memo.size <= 10_000
    assert memo["x" * 5000] == "x" * 10_000 and "x" * 5000 not in memo


def test_language(spark):
    en, de = "the house and the garden are with this man", "das haus und der garten sind bei diesem mann"
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de"), (None, "en"), ("x", None)] * 3)]
    samples = langid.fit_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [lang for lang, _ in samples] == ["de", "en"]
    got = langid.with_language(texts(spark, ["the man and the house", "der mann und das haus", None, "", "123 !", "the man and the house"]), samples).orderBy("doc_id").collect()
    assert [r["language"]["lang_pred"] for r in got] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["language"]["score"] <= 1 for r in got)
    assert langid.with_language(texts(spark, ["a b"]), ()).first()["language"]["lang_pred"] == "und"


def cross_parsed(text, sample):
    """Phrases by the definition: from each place the longest part of the sample, or one character."""
    at = phrases = 0
    while at < len(text):
        n = max((k for k in range(len(text) - at + 1) if text[at : at + k] in sample), default=0)
        at += max(1, n)
        phrases += 1
    return phrases


def test_longest_matches():
    rng = random.Random(5)
    sample = "".join(rng.choice("abc") for _ in range(60))
    automaton = langid.SuffixAutomaton(sample)
    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(15)))
        assert automaton.phrases(text) == cross_parsed(text, sample)


def test_language_is_that_of_the_fewest_phrases(spark):
    """Against the definition, on whole texts: phrases run on over words."""
    rng = random.Random(15)
    syllables = {"aa": "ba be bi la".split(), "bb": "ba bo bu lo".split(), "cc": "ka ke bi lo".split()}
    say = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i, lang in enumerate(sorted(syllables) * 20)]
    samples = langid.fit_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=8, piece_chars=50)
    assert all(50 < len(sample) <= 8 * 55 for _, sample in samples)
    values = [say(rng.choice(sorted(syllables)), rng.randrange(1, 25)).replace(" ", rng.choice([" ", ", ", "! 1 ", "\n"])) for _ in range(150)] + ["Ba-BE 12", "ça"]
    for r in langid.with_language(texts(spark, values), samples).collect():
        parsed = langid.letters(values[r["doc_id"]])
        counts = {lang: cross_parsed(parsed, sample) for lang, sample in samples}
        best = min(counts, key=lambda lang: (counts[lang], lang))
        assert r["language"]["lang_pred"] == best and abs(r["language"]["phrases_per_char"] - counts[best] / len(parsed)) < 1e-12
    held_out = [(lang, say(lang, 20)) for lang in sorted(syllables) * 20]
    got = langid.with_language(texts(spark, [t for _, t in held_out]), samples).orderBy("doc_id").collect()
    assert sum(r["language"]["lang_pred"] == lang for r, (lang, _) in zip(got, held_out, strict=True)) >= 58


def test_language_fits_within_its_bounds(spark):
    """Rows that share a key, long texts and an empty table."""
    rows = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.repeat(F.lit("word "), 1000), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    ((lang, sample),) = langid.fit_samples(rows)
    assert lang == "en" and len(sample) <= langid.PIECE_CHARS + 1
    assert langid.fit_samples(rows.limit(0)) == () and langid.with_language(rows.limit(0), ()).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    plain = [f"w{i}x" for i in range(200)]
    rows = []
    for i in range(400):
        words = rng.choices(plain, k=30)
        if bad := i % 4 == 0:
            words[5:7] = [rng.choice(["idiot", "scumbags", "scumlike"]), "you"]
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), "doc_id", "text", "toxic")
    out = toxicity.scored(texts(spark, ["w1x w2x idiot you w3x", "w1x w2x w3x", None, "", "w1x w2x idiot you w3x"]), scorer, score_col="score").orderBy("doc_id").collect()
    assert out[0]["score"] > 0.7 > out[1]["score"] and out[0]["score"] == out[4]["score"] and out[0]["prediction"] == "keep"
    assert all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.scored(texts(spark, ["a"]).limit(0), scorer).count() == 0
    clashing = texts(spark, ["w1x idiot you"]).withColumns({c: F.lit(c) for c in ("_features", "_raw", "features", "_p", "_score")})
    assert toxicity.scored(clashing, scorer).first()["_p"] == "_p"
    twice = toxicity.fit(df.select("doc_id", "text").union(df.select("doc_id", "text").limit(9)), df.select("doc_id", "toxic").union(df.select("doc_id", "toxic").limit(9)), "doc_id", "text", "toxic")
    assert toxicity.scored(texts(spark, ["w1x w2x idiot you w3x"]), twice).first()["toxicity"] > 0.7
    none = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0), "doc_id", "text", "toxic")
    assert {r["toxicity"] for r in toxicity.scored(texts(spark, ["a", None]), none).collect()} == {0.0}


def brute_components(sets, percent):
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(7)
    values = []
    for _ in range(12):
        base = [rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.choice([6, 12, 40, 90, 160]))]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(99)}"
            values.append(" ".join(words))
    values += ["", None, "one two", "One  two", "x"]
    sets = {}
    for i, t in enumerate(values):
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    want = brute_components(sets, 85)
    df = texts(spark, values)
    got = neardup.near_duplicates(df.union(df.where("doc_id = 3"))).collect()
    assert len(got) == len(values) + 1
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    null = neardup.near_duplicates(texts(spark, ["a b c"]).withColumn("doc_id", F.lit(None).cast("long"))).first()
    assert (null["component_id"], null["kept"]) == (None, True)


@pytest.mark.parametrize("block", [8, 4096])
def test_near_duplicates_of_a_template(spark, monkeypatch, block):
    """Thousands of pages that share most bins by their common part and have no link, among them a few true pairs; in large buckets and in small ones."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    shared = " ".join(f"common{i}" for i in range(60))
    rng = random.Random(16)
    pages = [f"{shared} " + " ".join(f"p{i}x{j}" for j in range(60)) for i in range(1500)]
    sets = []
    for i in range(0, 300, 10):  # copies of pages with a changed word at the end of their own part, or two
        words = pages[i].split()
        for at in rng.sample(range(100, 120), 1 + i % 20 // 10):
            words[at] = f"z{at}"
        pages.append(" ".join(words))
    for page in pages:
        w = page.split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(texts(spark, pages)).collect()}
    for i, page in enumerate(pages):
        twin = (i - 1500) * 10
        linked = i >= 1500 and 100 * len(sets[i] & sets[twin]) >= 85 * len(sets[i] | sets[twin])
        assert got[i] == (twin if linked else i)
    assert sum(d != c for d, c in got.items()) >= 15


def test_decontamination(spark):
    rng = random.Random(8)
    words = ["the", "of", "in"] * 20 + [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=18)) + ". " + " ".join(rng.choices(words, k=6)) + ".") for i in range(40)] + [(99, None), (98, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    values = []
    for i in range(80):
        body = " ".join(rng.choices(words, k=120))
        values.append(body + " " + (items[i % 40][1] + " " if i % 3 == 0 else "") + " ".join(rng.choices(words, k=100)))
    values += [None, "", items[5][1].upper(), items[6][1]]
    index = decontaminate.build_index(bench)
    got = {r["doc_id"]: {x["item_id"] for x in r["items"]} for r in decontaminate.with_items(texts(spark, values), index).collect()}
    flat = [" ".join(decontaminate.words(t)) for t in values]
    want = {d: {i for i, t in items if t and " ".join(decontaminate.words(t)) in x} for d, x in enumerate(flat)}
    assert got == want
    # in several parts, and with equal items and equal texts under two ids
    more = bench.union(bench.where("item_id = 5")).union(bench.where("item_id = 6").withColumn("item_id", F.lit(106).cast("long")))
    parts = decontaminate.build_index(more, part_items=8)
    out = decontaminate.with_items(texts(spark, values), parts)
    assert parts.count == 6 and out.columns == ["doc_id", "text", "prediction", "score", "items"]
    found = {r["doc_id"]: [x["item_id"] for x in r["items"]] for r in out.collect()}
    assert found == {d: sorted(x | ({106} if 6 in x else set())) for d, x in want.items()}
    assert decontaminate.with_items(texts(spark, values[:2]), decontaminate.build_index(bench.limit(0))).first()["items"] == []
    assert decontaminate.with_items(texts(spark, values[:2]).limit(0), index).count() == 0


def overlaps(text, item):
    """Shares of the question's and of the answer's word trigrams that stand in a text; by the definition."""
    found = decontaminate.words(text)
    parts = [decontaminate.words(x) for x in item.strip().split(". ")]
    out = []
    for part in ([w for x in parts[:-1] for w in x], parts[-1]):
        grams = {tuple(part[i : i + 3]) for i in range(len(part) - 2)}
        out.append(len(grams & {tuple(found[i : i + 3]) for i in range(len(found) - 2)}) / len(grams))
    return out


def test_gate_lets_through_what_the_overlap_confirms():
    """Items with a few changed words, the rarest ones too: all that pass the overlap test are found, and no others."""
    rng = random.Random(18)
    common, rare = ["the", "of", "in", "to"], [f"w{i}" for i in range(900)]
    say = lambda n: [rng.choice(common if rng.random() < 0.4 else rare) for _ in range(n)]
    items = [f"{' '.join(say(rng.randrange(9, 30)))}. {' '.join(say(rng.randrange(6, 20)))}." for _ in range(60)]
    index = decontaminate.Index(list(enumerate(items)))
    passed = 0
    for trial in range(400):
        i = trial % 60
        words = items[i].split(" ")
        for at in rng.sample(range(len(words)), rng.randrange(0, 6)):
            words[at] = "changed" + "." * words[at].endswith(".")
        text = " ".join([*say(150), *words, *say(80)])
        question, answer = overlaps(text, items[i])
        near = question >= decontaminate.QUESTION and answer >= decontaminate.ANSWER
        passed += near
        assert (i in {x for x, *_ in index.contained(text)}) == near
    assert 100 < passed < 390


def test_items_of_many_lengths():
    rng = random.Random(19)
    items = [(i, " ".join(f"v{rng.randrange(3000)}" for _ in range(n))) for i, n in enumerate([3, 20, 64, 65, 200, 700, 2000])]
    index = decontaminate.Index(items)
    assert len(index.lists) == 5
    text = " ".join(["zz"] * 500 + items[2][1].split() + ["zz"] * 77 + items[6][1].split() + items[0][1].split())
    assert [i for i, *_ in index.contained(text)] == [0, 2, 6]


def test_block_max_wand_finds_all_and_skips(monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(30 * (i % 4), 30 * (i % 4) + 30)] + ["the"], k=8))) for i in range(1200)]
    searched = {}
    for block in (10_000, 16, 4):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        (lists,) = decontaminate.Index(items, share=0.7).lists
        some, ranges = random.Random(1), 0
        for _ in range(50):
            terms = some.sample(range(len(lists.first) - 1), 20)
            want = {i: sum(x for t, x in item.terms.items() if t in terms) for i, item in enumerate(lists.items)}
            want = {i: s for i, s in want.items() if s >= 1 - 1e-9}
            live = lists.live(np.array(terms[: 4 * lists.longest]))[1].tolist()
            got = dict(x for r in live for x in lists.search(set(terms), r))
            ranges += len(live) * min(block, len(items))
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
        searched[block] = ranges
    assert searched[4] < searched[16] < searched[10_000]  # the maxima of blocks pass over more than those of whole lists


def test_passages_hold_every_run_of_the_longest_item():
    rng = random.Random(17)
    items = [(i, " ".join(f"x{i}y{j}" for j in range(n))) for i, n in enumerate([10, 7, 5])]
    index = decontaminate.Index(items)
    for at in range(130):
        words = ["zz"] * 130
        item = rng.randrange(3)
        words[at:at] = items[item][1].split()
        assert [i for i, *_ in index.contained(" ".join(words))] == [item]


def test_url_rules_and_model(spark):
    rows = ["http://A.Example.org/es/1", "http://example.org/en/1", "http://x.com/de/5", "http://x.com/fr/5", "http://fr.com/zz", "no url", None, "http://a.org", "http://b.net/de/7?q#f", "http://org/x"]
    rng = random.Random(13)
    rows = rows + [f"http://h{rng.randrange(999)}.com/{rng.choice(('de', 'fr'))}/{rng.randrange(999)}" for _ in range(200)]
    clashing = ["features", "label", "verdict", "rawPrediction", "probability", "_probability", "prediction", "_grams"]
    df = urlfilter.with_parts(spark.createDataFrame([(i, u, *clashing) for i, u in enumerate(rows)], ["page_id", "url", *clashing]))
    labelled = urlfilter.labelled_urls(df, URL_RULES)
    model = urlfilter.fit(labelled)
    judged = urlfilter.judged(df, URL_RULES, model)
    out = {r["page_id"]: r for r in judged.collect()}
    assert all(out[0][c] == c for c in clashing if c != "verdict") and sorted(judged.columns) == sorted(["page_id", "url", "host", "path", "rule", "score", *clashing])
    assert [(out[i]["host"], out[i]["path"], out[i]["rule"]) for i in range(10)] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/1", "example.org/en/1"), ("x.com", "/de/5", "com/de/"), ("x.com", "/fr/5", "com/fr/"), ("fr.com", "/zz", None),
        ("", "", None), ("", "", None), ("a.org", "", None), ("b.net", "/de/7", None), ("org", "/x", "org/"),
    ]
    assert [out[i]["verdict"] for i in (0, 1, 2, 3, 9)] == ["block", "block", "block", "allow", "allow"] and out[8]["verdict"] == "block"
    assert urlfilter.fit(urlfilter.labelled_urls(df.limit(0), URL_RULES)) == "allow" and urlfilter.judged(df.limit(0), URL_RULES, model).count() == 0
    # the regression by hand: distinct n-grams of host and path, hashed, weighed, summed
    hashing = urlfilter.hashing("grams", "features")
    for i in (2, 4, 5, 8, 60):
        grams = set()
        for mark, part in (("h", out[i]["host"]), ("p", out[i]["path"])):
            whole = f"^{part}$"
            grams |= {f"{mark}{n}{whole[j : j + n]}" for n in urlfilter.SIZES for j in range(len(whole) - n + 1)}
        z = model.intercept + sum(model.coefficients[j] for j in {hashing.indexOf(g) for g in grams})
        assert abs(out[i]["score"] - 1 / (1 + np.exp(-z))) < 1e-9
        assert out[i]["rule"] or out[i]["verdict"] == ("block" if out[i]["score"] >= 0.5 else "allow")
    rates = urlfilter.held_out_rates(labelled)
    assert rates["rows"] > 10 and rates["right"] > 0.9


def test_any_number_of_url_rules(spark):
    rules = [("block" if i % 2 else "allow", f"h{i}.com/{'x' * (i % 3)}") for i in range(2_000)] + [("block", "h7.com/y"), ("allow", "h7.com/y")]
    urls = [(i, f"http://a.h{i}.com/xy") for i in range(0, 3000, 7)] + [(9000, "http://h7.com/yes"), (9001, "http://xh7.com/y")]
    df = urlfilter.with_parts(spark.createDataFrame(urls, "page_id long, url string"))
    got = {r["page_id"]: (r["rule"], r["rule_verdict"]) for r in urlfilter.with_rule(df, rules).collect()}
    for i, _ in urls[:-2]:
        fits = i < 2000 and i % 3 < 2
        assert got[i] == ((f"h{i}.com/{'x' * (i % 3)}", "block" if i % 2 else "allow") if fits else (None, None))
    assert got[9000] == ("h7.com/y", "block") and got[9001] == (None, None)


def brute_nearest(vectors, ids, queries, k):
    out = {}
    for q in queries:
        scores = vectors @ vectors[ids.index(q)]
        out[q] = [ids[j] for j in sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-scores[j], ids[j]))[:k]]
    return out


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 60)
    rng = np.random.default_rng(10)
    x = rng.standard_normal((600, 24)).astype(np.float32)
    x[100:160] = x[100]  # copies
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x"), (920, [0.0] * 24, "x"), (940, [float("nan")] * 24, "x"), (960, [1.0, None], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in ann.nearest(df, 10, lambda c: c % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(x.astype(float), list(range(600)), range(0, 600, 20), 10)
    assert got.keys() == want.keys() and all([r for r, _, _ in v] == list(range(1, 11)) for v in got.values())
    found = sum(len({v for _, v, _ in got[q]} & set(want[q])) for q in want) / (10 * len(want))
    assert found >= 0.9
    assert [v for _, v, _ in got[100]] == list(range(101, 111))  # ties among the copies
    few = ann.nearest(df.where("vec_id < 5"), 10, lambda c: c % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert ann.nearest(df.where("vec_id >= 900"), 10, lambda c: c % 20 == 0).count() == 0


def test_nearest_ties_go_to_the_smaller_id(spark):
    """400 different vectors with one product, more than a query's k and dealt over lists; and many ids of one vector."""
    rows = [(i, [1.0, float((i * 37) % 400), 1.0]) for i in range(1, 400)] + [(0, [1.0, 0.0, 0.0])] + [(1000 + i, [-1.0, 2.0, 5.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df.repartition(7), 20, lambda c: c.isin(0, 1001)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[0] == [(i, 1.0) for i in range(1, 21)]
    x = np.array([v for _, v in rows])
    assert [i for i, _ in got[1001]] == brute_nearest(x, [i for i, _ in rows], [1001], 20)[1001]


def test_nearest_beyond_the_sample(spark, monkeypatch):
    """Most vectors are outside the sample, so the lists decide; and what they lead to is not a sample's own result."""
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 600)
    monkeypatch.setattr(ann, "FIT_ROWS", 1000)
    monkeypatch.setattr(ann, "LIST_ROWS", 250)
    x = np.random.default_rng(20).standard_normal((6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = brute_nearest(x.astype(float), list(range(6000)), range(0, 6000, 100), 10)

    def recall(**options):
        got = defaultdict(list)
        for r in ann.nearest(df, 10, lambda c: c % 100 == 0, **options).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["vec_id"])
        assert got.keys() == want.keys() and all(len(set(v)) == 10 for v in got.values())
        return sum(len(set(got[q]) & set(want[q])) for q in want) / (10 * len(want))

    assert recall() >= 0.9
    assert recall(target=0.05) < 0.9  # bad lists show
    fit = ann._fit

    def nowhere(*args, **options):  # lists that find nothing: every query is searched again
        index = fit(*args, **options)
        index.centres = np.vstack([index.centres, 1e9 * np.ones((1, index.width))])
        index.probes = 0
        return index

    monkeypatch.setattr(ann, "_fit", nowhere)
    assert recall() == 1.0


def test_probes_hold_for_unseen_vectors():
    """The rows are many times the samples, as in a large table."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((40_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = ann._fit(x[:2000], x[2000:3000], 4_000_000, 20, ann.TARGET)
    assert len(index.centres) == 2000 // ann.CENTRE_ROWS and index.probes < len(index.centres)
    queries, rest = x[3000:3100], x[3100:]
    best = np.argsort(-(queries @ rest.T), axis=1)[:, :20]
    probed = ann._probe_order(queries, index.centres)[:, : index.probes]
    lists = ann._nearest_centre(rest, index.centres)[best]
    assert np.mean([np.isin(a, b).mean() for a, b in zip(lists, probed, strict=True)]) >= 0.95


def test_chat_linear(spark):
    said = "<|im_end|><|im_start|>assistant ok \\ \\n <\\| x"
    rows = [(1, 1, "assistant", said), (1, 0, "user", None), (2, 0, "us\ner<|im_end|>", "a\n"), (None, 0, "assistant", "n"), (1, 2, None, "t"), (1, 2, None, "t")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.linear_replies(turns))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", ""), ("assistant", said), ("", "t"), ("", "t")]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("us\ner<|im_end|>", "a\n")]
    assert got[1]["loss_text"] == said and got[None]["loss_text"] == "n" and got[2]["loss_text"] == ""
    assert chat.formatted(chat.linear_replies(turns.limit(0))).count() == 0


def test_chat_tree_paths(spark):
    rng = random.Random(11)
    rows = [(0, 0, None, "user", "0", 0.0)]
    parent = {0: None}
    for n in range(1, 60):
        parent[n] = rng.randrange(max(0, n - 6), n)
        rows.append((0, n, parent[n], "assistant", str(n), round(rng.random(), 3)))
    rows += [(1, 100 + i, 99 + i if i else None, "user", str(i), 0.0) for i in range(37)]
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, s double")
    score = {r[1]: r[5] for r in rows}
    parent |= {100 + i: 99 + i if i else None for i in range(37)}

    def path(n):
        return [] if n is None else [*path(parent[n]), n]

    leaves = [n for n in parent if n < 100 and n not in parent.values()]
    ranked = sorted(leaves, key=lambda n: (-round(sum(score[x] for x in path(n)), 9), -len(path(n)), n))[:3]
    got = defaultdict(list)
    for r in chat.best_paths(df, best=3, score_col="s").orderBy("position").collect():
        got[r["conv_id"], r["rank"]].append(r["node"])
    assert [got[0, i] for i in (1, 2, 3)] == [path(n) for n in ranked] and got[1, 1] == list(range(100, 137))


def test_crc_of_stored_ids(spark):
    stored = tokenstore.read_shards(tokenstore.write_shards(texts(spark, ["hello world"]), WORD_BPE, end_id=1))
    ids = [*Tokenizer.from_file(WORD_BPE).encode("hello world", add_special_tokens=False).ids, 1]
    assert stored.select(F.crc32("ids")).first()[0] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert Counter(ids)[1] == 1


def test_nearest_in_rounds_of_queries(spark, monkeypatch):
    """Many rounds, small blocks and frequent cuts find what one round finds; no query or vector is dealt by a shuffle."""
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 300)
    x = np.random.default_rng(22).standard_normal((2000, 16)).astype(np.float32)
    x[500:540] = x[500]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    rows = lambda: sorted(map(tuple, ann.nearest(df, 10, lambda c: c % 10 == 0, target=1.0).collect()))
    whole = rows()
    for name, value in (("ROUND_BYTES", 40 * 16 * 8), ("QUERIES", 7), ("BLOCK", 11), ("KEPT", 50)):
        monkeypatch.setattr(ann, name, value, raising=False)
    rounds, put = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (isinstance(value, tuple) and rounds.append(value[1].nbytes), put(self, value))[1])
    assert rows() == whole
    want = brute_nearest(x.astype(float), list(range(2000)), [0, 990, 1990], 10)
    assert all([v for q, _, v, _ in whole if q == query] == want[query] for query in want)
    assert len(rounds) >= 5 and max(rounds) <= 3 * 40 * 16 * 8

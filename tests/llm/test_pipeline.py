"""The pipeline against a brute-force version of its decisions, and the registration of its queries."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from dawnline.llm import queries
from dawnline.llm.shared import scratch, stored


def test_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in queries.QUERIES} and "pipeline" in found
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "byte_bpe"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    path = tmp_path_factory.mktemp("corpus")
    vocabulary = {"en": ["the", "and", "house", "river", "walking"], "de": ["der", "und", "haus", "fluss", "gehen"]}
    docs, labels = [], []
    items = [(i, " ".join(f"bench{i}x{j}" for j in range(20)) + ".") for i in range(3)]
    for i in range(300):
        lang = "en" if i % 3 else "de"
        words = [rng.choice(vocabulary[lang]) + rng.choice(["", "s", f"q{rng.randrange(500)}"]) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            words[3:3] = ["moron", "you", "moronic"]
        if i % 17 == 1:
            words[9:9] = items[i % 3][1].split()
        docs.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 1, int(toxic)))
    for i in range(20):  # copies of clean documents
        docs.append((1000 + i, docs[7][1], "en", "s", 0))
    docs += [(2000, None, "en", "s", 0), (2001, "12 34", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items


def test_pipeline_keeps_the_clean(spark, corpus):
    path, docs, items = corpus
    clean = {d for d, t, *_ in docs if t and t != "12 34" and "moron" not in t and not any(x.rstrip(".") in t for _, x in items) and d < 1000}
    got = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in got} == clean and all(len(r["ids_sha256"]) == 64 for r in got)


def test_stages_return_the_columns_of_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus[0]).columns == docs.columns


def test_stages_take_empty_tables_and_clashing_columns(spark, corpus):
    """No rows, and columns named like what the stages use inside; then null, empty and letterless texts and repeated rows."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    more = docs.where("doc_id in (1, 2, 7)").unionByName(docs.where("doc_id = 2")).unionByName(docs.where("doc_id >= 2000"))
    for name in ("language", "_language", "toxicity", "_toxicity", "items", "_items", "features", "_bucket", "_key", "found", "kept", "component_id"):
        more = more.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), corpus[0]).count() == 0
        kept = stage(spark, more, corpus[0])
        assert kept.columns == more.columns and {r["_items"] for r in kept.collect()} <= {"_items"}
    assert corpus_pipeline.encode(spark, docs.limit(0), corpus[0]).count() == 0
    odd = more.where("doc_id >= 2000")
    assert corpus_pipeline.language(spark, odd, corpus[0]).count() == 0 and corpus_pipeline.near_duplicates(spark, odd, corpus[0]).count() == 2


def test_texts_that_no_learned_language_explains_go(spark, corpus):
    """Unlearned letters go, also with a few learned words or digits between; a text with some such words, one word and one letter stay."""
    english = "the house and the walking river and houses "
    texts = {
        1: "мы идём к реке за домом и обратно",
        2: "мы идём к реке the 2024 за домом и обратно, " * 2000,
        3: "το σπίτι και το ποτάμι",
        4: english + "дом",
        5: "river",
        6: "a",
        7: english * 5000,
    }
    labelled = spark.read.parquet(f"{corpus[0]}/documents.parquet").where("lang is not null and doc_id < 300")
    more = labelled.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(5000 + k, t, None) for k, t in texts.items()], "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, more, corpus[0]).collect()}
    assert kept == set(range(300)) | {5004, 5005, 5006, 5007}


def test_stages_leave_no_tables_behind(spark, tmp_path):
    rows = spark.range(3).select("id")
    with scratch(spark):
        assert stored(spark, rows, "left").count() == 3
        path = stored(spark, rows, "left").inputFiles()[0].rsplit("/", 1)[0]
    assert not os.path.exists(path.removeprefix("file:").replace("///", "/"))


def test_near_duplicates_at_four_fifths(spark):
    """Of 94 distinct words, two changed ones leave 80 of 100 shingles; of 93, 79 of 99."""
    rows = []
    for i in range(40):
        words = [f"w{i}x{j}" for j in range(94 - i % 2)]
        other = list(words)
        other[20] = other[60] = f"z{i}"
        rows += [(2 * i, " ".join(words), "kept"), (2 * i + 1, " ".join(other), "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {d for d in range(80) if d % 4 != 1}

"""Five stages from raw documents to token ids: language, toxicity, near-duplicates, benchmark items, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; its result is written as Parquet
and read again as the next one's docs, and what a stage has kept beside it is deleted. Filtering stages return the columns
of their input, whatever their names. Rows that share a doc_id are one document to the near-duplicate stage and stay or go
together; rows without one can't be named by a group and stay. A null, empty or letterless text has no language and goes at
the first stage; very long texts pass through every stage whole; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnline.llm import bpe, decontaminate, langid, neardup, toxicity
from dawnline.llm.queries import BYTE_BPE, in_fold, table
from dawnline.llm.shared import scratch, shared_path, stored, unused

#: Phrases per character of the best language, from which on a text is in none of them: a text in unlearned letters has about
#: one, and no labelled document of the test tables (61,282 of two) has more than 0.5.
FOREIGN_FROM = 0.6
TOXIC_FROM = 0.7
#: Of each cache of the last stage; its workers have run four stages before, whose memory the system has not all got back.
CACHE_BYTES = 16 << 20
DUPLICATE_PERCENT, DUPLICATE_BANDS = 80, 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go: no text, no letter, or FOREIGN_FROM phrases per character or more in each language."""
    samples = langid.fit_samples(docs.where(~in_fold("doc_id", 4, 2)))
    out = unused(docs, "language")[0]
    found = langid.with_language(docs, samples, out=out)
    return found.where((F.col(out)["lang_pred"] != langid.UNKNOWN) & (F.col(out)["phrases_per_char"] < FOREIGN_FROM)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC_FROM or more go."""
    labels = table(spark, sf_dir, "labels").where(~in_fold("doc_id", 3, 1)).select("doc_id", "toxic")
    scorer = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    out = unused(docs, "toxicity")[0]
    return toxicity.scored(docs, scorer, score_col=out).where(F.col(out) < TOXIC_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id stays."""
    gone = neardup.near_duplicates(docs.select("doc_id", "text"), k=5, percent=DUPLICATE_PERCENT, count=DUPLICATE_BANDS).where("not kept").select("doc_id")
    # as a table, whose size Spark knows: a short one is sent to the texts, and only a long one is worth a shuffle of them
    gone = stored(spark, gone, "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    index = decontaminate.build_index(table(spark, sf_dir, "benchmark"))
    out = unused(docs, "items")[0]
    return decontaminate.with_items(docs, index, out=out).where(F.size(out) == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    return bpe.digests(bpe.encode_and_decode(docs.select("doc_id", "text"), BYTE_BPE, public_tokenizers.PATTERN, cache_bytes=CACHE_BYTES))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", contaminated), ("byte_bpe", encode)]

#: Learned models, signatures and merges have no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

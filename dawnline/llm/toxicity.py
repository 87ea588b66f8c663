"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

The lexicon is learned from the labelled rows: words and word beginnings that are far more frequent in toxic than in
other texts, where a text counts a term TERM_CAP times at most; callers may add words of their own. The features of a text are densities and weights of lexicon
words, how near they are to second-person words, and the rates of capitals, punctuation and obfuscated words (letters
mixed with digits or symbols). Two fifths of the labelled rows name the lexicon, two fifths fit the trees, and on the last
fifth an isotonic regression turns the trees' score into the share of toxic rows.

Fitting uses a sample of at most about max_rows labelled rows of each label, picked by hash, and the lexicon holds the
MAX_LEXICON terms of highest odds at most: both bound what a model is, and what is sent to the tasks.

Defined results: null or empty text gets the features of no words, and a score like any other; a very long text is read
whole; without labelled rows of both labels every score is the share of toxic ones (0 with none, as with an empty table);
several labels of one key each count as a row; repeated rows are scored one by one; an empty table gives no rows; an
existing column named like an output is replaced; extra columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnline.llm.shared import Memo, held, ready, stored, unused

MAX_ROWS, MAX_LEXICON = 6_000, 4_000
STEMS = (4, 5, 6, 7, 8)
MIN_DOCS, MIN_ODDS, MIN_DEVIATION, TERM_CAP = 5, 1.8, 4.0, 3
TREES, DEPTH = 20, 4
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer eure tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vos vosotros tuyo tuya su sus".split()
)
FEATURES = ("words", "hits", "hit_share", "top_weight", "weight_share", "weight_sum", "near_second", "second_share", "capitals", "exclamations", "punctuation", "obfuscated", "obfuscated_hits")
_WORD = re.compile(r"[^\W_]+(?:[*@$!|0-9+._-]+[^\W_]+)*[*@$]*")
_LEET = str.maketrans("013457@$!|+", "oieastasiit")
_SIGNS = re.compile(r"[^\w\s]")
_NO_HIT = 99.0


@dataclass(frozen=True)
class Lexicon:
    """Weights (log odds) of short whole words (marked =) and of beginnings (marked ~)."""

    weights: tuple[tuple[str, float], ...]


def terms(word: str) -> list[str]:
    whole = [f"={word}"] if 1 < len(word) <= STEMS[-1] else []
    return whole + [f"{word[:n]}~" for n in STEMS if len(word) >= n]


class Reader:
    """Features of texts under a lexicon; what is known of a word is looked up once."""

    def __init__(self, lexicon: Lexicon):
        self.weights = dict(lexicon.weights)
        self.known = Memo(self._look)

    def _weight(self, word: str) -> float:
        return max((self.weights.get(t, 0.0) for t in terms(word)), default=0.0)

    def _look(self, word: str) -> bytes:
        low = word.lower()
        plain = low.translate(_LEET)
        mixed = float(plain != low and any(c.isalpha() for c in low) or any(c in "*@$" for c in low))
        bare = re.sub(r"[^\w]|_", "", plain)
        weight = max(self._weight(low), self._weight(bare) if mixed else 0.0)
        caps = float(len(word) > 1 and word.isupper())
        return np.array([weight, low in SECOND_PERSON, caps, mixed], dtype=np.float32).tobytes()

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = _WORD.findall(text)
        if not words:
            return [0.0] * 6 + [_NO_HIT] + [0.0] * 6
        seen = np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype=np.float32).reshape(-1, 4)
        n, weight = len(words), seen[:, 0]
        hits, second = np.flatnonzero(weight), np.flatnonzero(seen[:, 1])
        near = _NO_HIT
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            right = second[np.minimum(at, len(second) - 1)]
            left = second[np.maximum(at - 1, 0)]
            near = float(min(_NO_HIT, np.minimum(abs(right - hits), abs(left - hits)).min()))
        marks = text.count("!") + text.count("?")
        return [
            math.log1p(n), math.log1p(len(hits)), len(hits) / n, float(weight.max()), float(weight.sum()) / n, math.log1p(float(weight.sum())), near,
            len(second) / n, float(seen[:, 2].sum()) / n, marks / n, len(_SIGNS.findall(text)) / n, float(seen[:, 3].sum()) / n, float((seen[:, 3] * (weight > 0)).sum()),
        ]


def reader(lexicon: Lexicon) -> Reader:
    return held(Reader, lexicon)


def features(text: Column | str, lexicon: Lexicon) -> Column:
    """array<double>: FEATURES of each text."""

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        read = reader(lexicon).features
        return pa.array([read(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return measure(text)


def learn_lexicon(labelled: DataFrame, text_col: str, label_col: str, added: dict[str, float] | None = None) -> Lexicon:
    """At most MAX_LEXICON words and beginnings, by log odds of their counts, TERM_CAP a text at most, in toxic and other rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(y, term, n) of each text, a few texts at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                ys, found, ns = [], [], []
                part = batch.slice(at, 32)
                for y, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    counts = Counter(t for w in _WORD.findall((text.as_py() or "").lower()) for t in terms(w))
                    ys += [y] * len(counts)
                    found += counts
                    ns += [min(n, TERM_CAP) for n in counts.values()]
                yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(found, pa.string()), pa.array(ns, pa.int64())], names=["y", "term", "n"])

    rows = labelled.select(F.col(label_col).cast("int").alias("y"), text_col).mapInArrow(counted, "y int, term string, n long")
    total = labelled.agg(F.sum(label_col).alias("toxic"), F.count("*").alias("docs")).first()
    counts = rows.groupBy("term").agg(F.sum("y").alias("docs"), F.sum(F.col("y") * F.col("n")).alias("toxic"), F.sum((1 - F.col("y")) * F.col("n")).alias("other"))
    t, o = float(total["toxic"] or 0), float(total["docs"] - (total["toxic"] or 0))
    odds = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("other") + 0.5) / (o + 1))
    expected = F.col("other") * (t / max(o, 1.0))
    best = counts.where((F.col("docs") >= MIN_DOCS) & ((F.col("toxic") - expected) / F.sqrt(expected + 1) >= MIN_DEVIATION))
    best = best.withColumn("odds", F.round(odds, 6)).where(F.col("odds") >= MIN_ODDS)
    best = best.orderBy(F.desc("odds"), F.desc("toxic"), "term").limit(MAX_LEXICON).collect()
    return Lexicon(tuple(sorted({**{r["term"]: r["odds"] for r in best}, **{f"={w}": x for w, x in (added or {}).items()}}.items())))


@dataclass
class Scorer:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float


def _by_hash(df: DataFrame, key_col: str, share: float) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(key_col, F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit(docs: DataFrame, labels: DataFrame, key_col: str, text_col: str, label_col: str, max_rows: int = MAX_ROWS, added: dict[str, float] | None = None) -> Scorer:
    """A scorer from docs' texts and labels' 0/1 labels, joined on key_col."""
    spark = docs.sparkSession
    ready(spark)
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(key_col).alias("key"), F.col(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Scorer(Lexicon(()), None, None, float(next(iter(counts), 0)))
    parts = [_by_hash(known.where(F.col("y") == y), "key", min(1.0, max_rows / n)) for y, n in counts.items()]
    # the labels are sampled before any text is read: about 2 * max_rows keys are broadcast
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    sample = stored(spark, texts.join(F.broadcast(parts[0].union(parts[1])), "key"), "labelled")
    # how the lexicon does is seen on rows that did not name it
    fold = F.pmod(F.xxhash64("key", F.lit(13)), F.lit(5))
    lexicon = learn_lexicon(sample.where(fold < 2), "text", "y", added)
    seen = sample.where(fold >= 2).select("key", fold.alias("fold"), F.col("y").cast("double").alias("label"), features(F.col("text"), lexicon).alias("f"))
    # every row counts as many as it stands for, so that scores keep the labels' true shares
    weight = F.when(F.col("label") == 1, max(1.0, counts[1] / max_rows)).otherwise(max(1.0, counts[0] / max_rows))
    seen = stored(spark, seen.withColumn("weight", weight), "features").withColumn("features", array_to_vector("f"))
    share = counts[1] / (counts[0] + counts[1])
    train = seen.where("fold < 4")
    if train.select("label").distinct().count() < 2:
        return Scorer(lexicon, None, None, share)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, weightCol="weight", seed=1).fit(train)
    held = trees.transform(seen.where("fold = 4")).withColumn("p", vector_to_array("probability")[1]).select("label", "weight", "p")
    if held.isEmpty():
        return Scorer(lexicon, trees, None, share)
    calibration = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(held)
    return Scorer(lexicon, trees, calibration, share)


def scored(df: DataFrame, scorer: Scorer, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """df with the calibrated score, 0 to 1."""
    ready(df.sparkSession)
    if scorer.trees is None:
        return df.withColumn(score_col, F.lit(scorer.share))
    kinds = ("features", "raw", "probability", "prediction", "p", "score")
    names = dict(zip(kinds, unused(df, *kinds), strict=True))
    trees = scorer.trees.copy()
    trees.setFeaturesCol(names["features"]).setRawPredictionCol(names["raw"]).setProbabilityCol(names["probability"]).setPredictionCol(names["prediction"])
    out = trees.transform(df.withColumn(names["features"], array_to_vector(features(F.col(text_col), scorer.lexicon))))
    out = out.withColumn(names["p"], vector_to_array(names["probability"])[1])
    if scorer.calibration is not None:
        calibration = scorer.calibration.copy()
        calibration.setFeaturesCol(names["p"]).setPredictionCol(names["score"])
        out = calibration.transform(out)
    else:
        out = out.withColumn(names["score"], F.col(names["p"]))
    return out.withColumn(score_col, F.greatest(F.lit(0.0), F.least(F.lit(1.0), names["score"]))).drop(*names.values())

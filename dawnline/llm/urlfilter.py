"""URL filters: rules first, and a logistic regression on hashed character n-grams where no rule fits.

Everything is DataFrame and MLlib code. The features are the distinct character n-grams of host and path, each marked
with its field and hashed to a fixed number of columns. The regression is trained on a small labelled URL table, of at
most about MAX_TRAIN_ROWS distinct urls: labelled_urls() makes one of the urls that rules decide, or callers bring theirs.
held_out_rates() tells how a model does on labelled urls that it has not been trained on.

Rules are one constant array, of any length, that each row's host and path are held against.

Defined results: a url that is null or has no '://' has an empty host and path; a very long url is read whole, and its
n-grams meet in the same fixed number of columns; without labelled rows of both verdicts the verdict is the only one known,
or 'allow'; of rules of one length the first wins; repeated rows are judged one by one; an existing column named like an
output is replaced, any other passes unchanged, whatever its name; an empty table gives no rows.
"""

from __future__ import annotations

import json
import string

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnline.llm.shared import stored, unused

MAX_TRAIN_ROWS = 4_000
COLUMNS, SIZES = 1 << 14, (2, 3, 4)
_RULE = "struct<host: string, path: string, size: int, place: int, rule: string, verdict: string>"


def host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end; A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """After the host up to '?', '#' or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    return df.withColumns({"host": host(url), "path": path(url)})


def with_rule(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """df (with host and path) with rule and rule_verdict: of (verdict, 'host/path') rules the longest that fits, the first on ties.

    A rule fits its host and all subdomains, if the path starts with the rule's path.
    """
    rows = []
    for i, (verdict, text) in enumerate(rules):
        name, _, rest = text.partition("/")
        rows.append({"host": name, "path": f"/{rest}", "size": len(text), "place": -i, "rule": text, "verdict": verdict})
    known = F.from_json(F.lit(json.dumps(rows)), f"array<{_RULE}>")

    def fits(r: Column) -> Column:
        return ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))) & F.col("path").startswith(r["path"])

    best = F.array_max(F.transform(F.filter(known, fits), lambda r: F.struct(r["size"], r["place"], r["rule"], r["verdict"])))
    return df.withColumns({"rule": best["rule"], "rule_verdict": best["verdict"]})


def labelled_urls(df: DataFrame, rules: list[tuple[str, str]], max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """A small labelled URL table of distinct host, path and verdict: at most about max_rows, by hash, of those that a rule decides."""
    rows = with_rule(df.select("host", "path"), rules).where("rule is not null").select("host", "path", F.col("rule_verdict").alias("verdict")).distinct()
    n = rows.count()
    return stored(df.sparkSession, _by_hash(rows, 0, min(1.0, max_rows / n) if n else 1.0), "urls")


def _by_hash(rows: DataFrame, since: float, until: float) -> DataFrame:
    place = F.pmod(F.xxhash64("host", "path"), F.lit(1 << 20))
    return rows.where((place >= int(since * (1 << 20))) & (place < int(until * (1 << 20))))


def _grams(text: Column, mark: str) -> Column:
    whole = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.when(F.length(whole) >= n, F.sequence(F.lit(1), F.length(whole) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(f"{mark}{n}"), F.substring(whole, i, F.lit(n))))

    return F.array_distinct(F.concat(*map(of_size, SIZES)))


def hashing(source: str, out: str) -> HashingTF:
    return HashingTF(numFeatures=COLUMNS, binary=True, inputCol=source, outputCol=out)


def with_features(df: DataFrame, out: str = "features") -> DataFrame:
    """df (with host and path) with the hashed n-grams as a sparse vector."""
    grams = unused(df, "grams")[0]
    rows = df.drop(out).withColumn(grams, F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))
    return hashing(grams, out).transform(rows).drop(grams)


def fit(labelled: DataFrame, label_col: str = "verdict", max_rows: int = MAX_TRAIN_ROWS) -> LogisticRegressionModel | str:
    """A model of P(block) from distinct (host, path) rows with verdicts, at most about max_rows by hash; or the only verdict known."""
    rows = labelled.select("host", "path", F.col(label_col).alias("verdict")).where("verdict is not null").distinct()
    counts = {r["verdict"]: r["count"] for r in rows.groupBy("verdict").count().collect()}
    if len(counts) < 2:
        return next(iter(counts), "allow")
    rows = _by_hash(rows, 0, min(1.0, max_rows / sum(counts.values())))
    rows = with_features(rows).select("features", (F.col("verdict") == "block").cast("double").alias("label"))
    return LogisticRegression(maxIter=30, regParam=0.01).fit(rows)


def with_score(df: DataFrame, model: LogisticRegressionModel | str, out: str = "score") -> DataFrame:
    """df (with host and path) with the model's P(block); nothing is shuffled for it."""
    if isinstance(model, str):
        return df.withColumn(out, F.lit(float(model == "block")))
    features, raw, probability, prediction = names = unused(df, "features", "raw", "probability", "prediction")
    own = model.copy().setFeaturesCol(features).setRawPredictionCol(raw).setProbabilityCol(probability).setPredictionCol(prediction)
    return own.transform(with_features(df, features)).withColumn(out, vector_to_array(probability)[1]).drop(*names)


def judged(df: DataFrame, rules: list[tuple[str, str]], model: LogisticRegressionModel | str) -> DataFrame:
    """df (with host and path) with rule, verdict and score, the model's P(block)."""
    scored = with_score(with_rule(df, rules), model)
    other = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("rule_verdict", other)).drop("rule_verdict")


def held_out_rates(labelled: DataFrame) -> dict[str, float]:
    """How a model trained on four fifths of labelled (host, path, verdict), by hash, judges the last fifth: rows, right, allowed_rightly, blocked_rightly."""
    model = fit(_by_hash(labelled, 0, 0.8))
    rows = with_score(_by_hash(labelled, 0.8, 1), model).select((F.col("verdict") == "block").alias("bad"), (F.col("score") >= 0.5).alias("blocked"))
    right = (F.col("bad") == F.col("blocked")).cast("double")
    of = rows.agg(F.count("*").alias("rows"), F.avg(right).alias("right"), F.avg(F.when(~F.col("bad"), right)).alias("allowed_rightly"), F.avg(F.when(F.col("bad"), right)).alias("blocked_rightly"))
    return of.first().asDict()

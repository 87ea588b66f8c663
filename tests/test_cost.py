"""What a text costs grows with its length: parts are computed once, and no pattern starts again at each character."""

import time

from pyspark.sql import functions as F

from dawnline.functions import labels, text
from dawnline.operators import generated
from dawnline.sources import feeds


def _told(spark, value):
    """The value of a column over one row, and the seconds that it took."""
    began = time.time()
    return spark.range(1).select(value.alias("v")).first()["v"], time.time() - began


def test_notes_of_a_long_sentence(spark):
    """120,000 characters without an end of a sentence, then one that is a note."""
    spark.createDataFrame([("word " * 24_000 + "\nIt is\nNow rolling out, e.g. here. Gradual.",)], "t string").createOrReplaceTempView("said")
    began = time.time()
    got = spark.table("said").select(labels.rollout_note(F.col("t")).alias("a"), labels.licence_note(F.col("t")).alias("b")).first()
    assert tuple(got) == ("Now rolling out, e.", "")
    assert time.time() - began < 20
    assert _told(spark, labels.licence_note(F.lit("One. Two needs E5\nThree.E3 is enough. ")))[0] == "E3 is enough."


def test_a_quote_is_sought_in_words_told_apart_once(spark):
    """A quote of 900 words, of which nine in ten stand in a text of 60,000."""
    told = spark.createDataFrame([(" ".join(f"wörd{i}x" for i in range(60_000)), " ".join(f"word{(i * 7) % 60_000}x" if i % 10 else "none" for i in range(900)))], "evidence string, quote string")
    began = time.time()
    got = told.select(text.quoted(F.col("quote"), F.col("evidence")).alias("a"), text.quoted(F.concat(F.col("quote"), F.lit(" none none")), F.col("evidence")).alias("b")).first()
    assert tuple(got) == (True, False)
    assert time.time() - began < 20


def test_validated_text_of_null_fields(spark):
    none = F.lit(None).cast("string")
    action = F.array(F.struct(F.lit("Do").alias("text"), F.lit("kaynak").alias("basis"), none.alias("evidence_quote")))
    made = generated.validated({"title_tr": F.lit("T"), "summary_tr": F.lit("KB5000001 CVE-2024-1234")}, action, F.lit("kb 5000001, cve-2024-1234"), F.array().cast("array<string>"))
    got = _told(spark, made)[0]
    assert (got["accepted"], got["unknown"], [tuple(a) for a in got["actions"]]) == (True, [], [("Do", "ai_cikarim", "")])
    assert _told(spark, generated.validated({"title_tr": F.lit("T"), "summary_tr": F.lit("KB5000001 cve-2024-1234")}, action, none, F.array().cast("array<string>")))[0]["unknown"] == ["KB5000001", "CVE-2024-1234"]


def test_market_objects_are_parsed_once(spark):
    rows = spark.createDataFrame([('{"USD": "x", "usd": {"Alış": "1,5", "Selling": "2"}, "b": {"İsim": "EURO", "Buying": "", "Satış": "3"}, "c": {"Name": "euro", "Buying": "9"}}',)], "p string")
    got = rows.select(feeds.market_quotes(F.col("p")).alias("r"))
    assert [tuple(q) for q in got.first()["r"]["quotes"]] == [("USDTRY", 1.5, 2.0), ("EURTRY", None, 3.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 2

"""Scalar functions on literals."""

import datetime

from pyspark.sql import functions as F

from dawnline.functions import dates, text, urls


def one(spark, value, column):
    schema = "x string"
    return spark.createDataFrame([(value,)], schema).select(column(F.col("x"))).first()[0]


def test_fold(spark):
    assert one(spark, "IŞIK Éclair ﬁ Å", text.fold) == "isik eclair fi a"
    assert one(spark, None, text.fold) == ""


def test_tokens(spark):
    assert one(spark, "The updates of 25 and 2024 İstanbul'da", text.tokens) == ["updat", "2024", "istan"]
    assert one(spark, "Windows update fails", lambda c: text.tokens(c, noise=["windows", "update"])) == ["fails"]


def test_identifiers(spark):
    s = "See KB5001234 and kb 5009999, CVE-2024-12345 on build 26100.1742; 99999.1 is none"
    assert one(spark, s, text.kbs) == ["5001234", "5009999"]
    assert one(spark, s, text.cves) == ["CVE-2024-12345"]
    assert one(spark, s, text.builds) == ["26100.1742"]
    assert one(spark, s, text.products) == ["win11-24h2", "ws2025"]


def test_fix_kbs(spark):
    s = "This is partially resolved in KB5000001. It is fixed by KB5000002.\nAn initial fix is KB5000002."
    found = one(spark, s, text.fix_kbs)
    assert (found["full"], found["partial"]) == (["5000002"], ["5000001"])


def test_tags(spark):
    assert one(spark, "Kerberos sign-in fails over VPN. This does not affect BitLocker.", text.symptom_tags) == ["auth", "vpn"]


def test_tags_compatible(spark):
    rows = [(["auth", "rds"], ["auth", "dc"]), (["rds"], ["rds", "auth"]), ([], ["dc"]), (["dc"], ["vpn"]), (["performance"], ["vpn"])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(text.tags_compatible(F.col("a"), F.col("b"))).collect()]
    assert got == [False, True, True, False, True]


def test_key_tokens(spark):
    assert set(one(spark, "Van'da 5,6 deprem", text.key_tokens)) == {"5.6", "van"}


def test_numbers(spark):
    assert [one(spark, s, text.locale_number) for s in ("4.123,45", "41.5", "%0,12", "x", None)] == [4123.45, 41.5, 0.12, None, None]


def test_truncate_and_sentences(spark):
    assert one(spark, "one two three four", lambda c: text.truncate(c, 10)) == "one two…"
    assert one(spark, "First one. Second one. Third.", text.first_sentences) == "First one. Second one."


def test_urls(spark):
    assert one(spark, "https://a.org/p?utm_source=x&id=1", urls.canonical) == "https://a.org/p&id=1"
    assert one(spark, "https://a.org/p?id=1&ref=x", urls.canonical) == "https://a.org/p?id=1"
    assert one(spark, "https://www.news.com.tr/a", urls.registrable_domain) == "news.com.tr"
    kinds = {"https://learn.microsoft.com/en-us/answers/questions/1": "community", "https://learn.microsoft.com/en-us/windows/x": "official", "https://www.reddit.com/r/x": "community", "https://www.bleepingcomputer.com/x": "press", "https://techcommunity.microsoft.com/blog/windows-itpro-blog/x": "official", None: "unknown"}
    assert {u: one(spark, u, urls.trust_of_url) for u in kinds} == kinds


def test_dates(spark):
    day = datetime.datetime(2026, 9, 8)
    for s in ("2026-09-08", "September 8, 2026", "Sept 8, 2026", "8 September 2026", "9/8/2026", "on 2026-09-08 UTC"):
        assert one(spark, s, dates.parse_loose) == day, s
    assert one(spark, "2026-09-14 10:00 PT", dates.parse_loose) == datetime.datetime(2026, 9, 14, 17)
    assert one(spark, "soon", dates.parse_loose) is None

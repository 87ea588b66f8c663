"""Event details without a shuffle, and summaries by rule on literals."""

import datetime

import pytest
from pyspark.sql import functions as F

from dawnline.functions import dates
from dawnline.operators import daily, detail, summaries
from dawnline.operators.fusion import Profile
from dawnline.plans import daily_queries


@pytest.fixture
def names(spark):
    t0 = datetime.datetime(2026, 9, 1)
    rows = lambda n, events=(1, 2): [(e, i, t0 + datetime.timedelta(hours=i), f"x{i}") for e in events for i in range(n)]
    frame = lambda data: spark.createDataFrame(data, "event long, id long, at timestamp, label string")
    histories = {
        "versions": frame(rows(3)), "evidence": frame(rows(2)).withColumn("source", F.lit("official")), "snapshots": frame([*rows(1), *rows(1), *rows(1, [2])]).drop("label"), "deliveries": frame(rows(25, [1])), "actions": frame([]),
    }
    names = detail.write_histories(histories, buckets=3)
    yield names
    detail.drop_histories(spark, names)


def test_event_details(spark, names):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    with detail.by_event_alone(spark):
        got = detail.event_details(spark, names, F.col("source"))
        plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan, plan
    rows = {(r["event"], r["part"], r["place"]): r for r in got.collect()}
    assert [rows[1, "version", p]["id"] for p in (1, 2, 3)] == [2, 1, 0]
    assert [(rows[e, "evidence", p]["label"], rows[e, "evidence", p]["count"]) for e in (1, 2) for p in (1, 2)] == [("official: x0", 2), ("official: x1", 0), ("official: x0", 3), ("official: x1", 0)]
    assert [r["id"] for k, r in sorted(rows.items()) if k[1] == "delivery"] == list(range(24, 4, -1)) and len(rows) == 6 + 4 + 20


def test_summaries_of_bare_and_full_events(spark):
    """Events of which nothing is known, and what only videos and long texts have."""
    kinds = [*summaries.ANY, "unheard"]
    bare = spark.createDataFrame(list(enumerate(kinds)), "event long, kind string")
    rows = {kinds[r["event"]]: r for r in summaries.summaries(bare, Profile()).collect()}
    assert rows["issue"]["summary"] == "Bildirilen sorun. Durum: ?." and rows["news"]["summary"] == "Özet metni yok." and rows["unheard"]["summary"] == "Özet metni yok."
    assert rows["release"]["title"] == "KB — Güncelleme" and rows["release"]["summary"].startswith("— tarihinde yayımlandı. Build: ?.")
    assert all(r["actions"] == [] and r["why"] for r in rows.values())
    full = bare.where("kind = 'content'").withColumns({"title": F.lit("A" * 200), "main_text": F.lit("One. " * 400), "is_video": F.lit(True), "has_transcript": F.lit(True)})
    row = summaries.summaries(full, Profile()).first()
    assert len(row["title"]) <= 160 and row["title"].endswith("…") and row["summary"] == "One. One. Transkript kullanıldı."
    issue = bare.where("kind = 'issue'").withColumns({"workaround_text": F.lit("word " * 100), "kir": F.lit(True), "resolving_kbs": F.array(F.lit("1")), "partial_fix_kbs": F.array(F.lit("2")), "main_text": F.lit("Status: Confirmed\n · History\nIt broke. Again.")})
    row = summaries.summaries(issue, Profile()).first()
    assert [(a["basis"], len(a["evidence_quote"]) <= 200) for a in row["actions"]] == [("kaynak", True), ("kaynak", True)] and row["actions"][1]["evidence_quote"] == "KB1"
    assert row["summary"].endswith("Kaynak (özgün dil): “It broke.”")
    assert summaries.summaries(bare.limit(0), Profile()).count() == 0


def test_long_labels(spark):
    day = F.lit("2026-09-26 05:00:00").cast("timestamp")
    row = spark.range(1).select(dates.long_label(day), dates.long_label(day, False), dates.long_label(F.lit(None).cast("timestamp")), dates.day_label(F.lit("2026-09-26").cast("date"))).first()
    assert list(row) == ["26 Eylül 2026 08:00", "26 Eylül 2026", "—", "26 Eylül 2026, Cumartesi"]


def test_intervals_overlap_days_by_the_microsecond(spark):
    """Ends a microsecond after midnight, at it and before it; a start before 1970; an interval of several days."""
    day, micro = (lambda n: datetime.datetime(2024, 1, n)), datetime.timedelta(microseconds=1)
    rows = [(1, day(1), day(2) + micro), (2, day(1), day(2)), (3, day(2) - micro, day(2) - micro), (4, day(2) - micro, day(2) + micro), (5, datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), day(1) + micro), (6, day(1) + 5 * micro, day(4) + micro)]
    intervals = spark.createDataFrame(rows, "id long, at timestamp, till timestamp")
    days = spark.createDataFrame([(datetime.datetime(1969, 12, 31),), *((day(n),) for n in (1, 2, 3, 4))], "day timestamp")
    got = {}
    for r in daily.overlapping(intervals, days, "at", "till", "day").collect():
        got.setdefault(r["id"], []).append(r["day"].day)
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 2], 2: [1], 3: [1], 4: [1, 2], 5: [1, 31], 6: [1, 2, 3, 4]}


def test_agenda_of_events_that_end_within_a_second_after_midnight(spark, tmp_path):
    """An event of one hour from 23:00:00.4 on ends on the next day."""
    events = spark.createDataFrame([(0, datetime.datetime(2024, 1, 1, 23, 0, 0, 400000)), (30, datetime.datetime(2024, 1, 2, 1))], "event_id long, ts timestamp")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["event_id"], r["day"].day) for r in daily_queries.j17_day_agenda(spark, str(tmp_path)).collect())
    assert got == [(0, 1), (0, 2), (30, 2)]

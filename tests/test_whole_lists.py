"""Reports and views that tell everything they are about, however much it is."""

from pyspark.sql import functions as F

from dawnline.operators import reports, selection

SOURCES = "source long"
HEALTH = "source long, last_ok long, last_status string, last_error long, checks long"


def test_coverage_lists_every_source_that_is_not_well(spark):
    """130 failing sources, 140 never checked, 3 well and 2 whose last success is too old."""
    health = [(i, i % 7, "error", i, 2) for i in range(130)] + [(i, 9, "view", None, 1) for i in range(130, 133)] + [(i, 4, "view", None, 1) for i in range(133, 135)]
    health.append((999, 1, "error", 5, 1))  # not enabled
    sources = spark.createDataFrame([(i,) for i in range(275)], SOURCES)
    rows = reports.coverage(sources, spark.createDataFrame(health, HEALTH), F.lit(5)).collect()
    assert {tuple(r)[:4] for r in rows} == {(275, 3, 130, 140)}
    want = [(i, "failing", "error", i % 7) for i in range(130)] + [(i, "never", None, None) for i in range(135, 275)]
    assert sorted(tuple(r)[4:] for r in rows) == want


def test_coverage_without_anything_to_list(spark):
    well = spark.createDataFrame([(1, 9, "view", None, 1)], HEALTH)
    assert [tuple(r) for r in reports.coverage(spark.createDataFrame([(1,)], SOURCES), well, F.lit(5)).collect()] == [(1, 1, 0, 0, None, None, None, None)]
    assert [tuple(r) for r in reports.coverage(spark.createDataFrame([], SOURCES), well, F.lit(5)).collect()] == [(0, 0, 0, 0, None, None, None, None)]


def test_critical_view_tells_every_risky_event(spark):
    """160 risky events of 240: old ones, irrelevant ones and ones without a time are told as such."""
    risks = ["critical", "high", "low"]
    rows = [(i, risks[i % 3], None if i % 8 == 7 else float(i % 4), None if i % 5 == 0 else i, i if i % 10 else None) for i in range(240)]
    events = spark.createDataFrame(rows, "event long, risk string, relevance double, changed_at long, first_seen long")
    got = [(r["event"], r["risk"], r["relevant"], r["recent"]) for r in selection.critical_view(events, F.lit(100)).collect()]
    risky = sorted((r for r in rows if r[1] != "low"), key=lambda r: (r[1] != "critical", r[3] is None, -(r[3] or 0), r[0]))
    last = [r[4] if r[3] is None else r[3] for r in risky]
    assert got == [(r[0], r[1], (r[2] or 0) > 0, at is not None and at >= 100) for r, at in zip(risky, last)]
    assert len(got) == 160 and {g[2:] for g in got} == {(a, b) for a in (True, False) for b in (True, False)}

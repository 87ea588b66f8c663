"""Dates: loose parsing, local days, quiet hours, ages, buckets. Timestamps are UTC instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dawnline.functions import fixed

PACIFIC = "America/Los_Angeles"
_NAMES = "|".join([*fixed.MONTHS_EN, "sept", *(m[:3] for m in fixed.MONTHS_EN)])


def _month(name: Column) -> Column:
    table = F.create_map(*(x for i, m in enumerate(fixed.MONTHS_EN, 1) for x in (F.lit(m[:3]), F.lit(i))))
    return table[F.substring(F.lower(name), 1, 3)]


def _stamp(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None) -> Column:
    return F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), hour if hour is not None else F.lit(0), minute if minute is not None else F.lit(0), F.lit(0))


def parse_loose(c: Column) -> Column:
    """ISO, 'yyyy-MM-dd HH:mm PT', 'Month d, yyyy', 'd Month yyyy', 'M/d/yyyy'; null if none; no time is midnight UTC."""
    s = F.trim(F.regexp_replace(F.translate(c, "\u00a0", " "), r"\s+", " "))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(s))
    day = r"(\d{4})-(\d{2})-(\d{2})(?:[ T](\d{1,2}):(\d{2}))?\s*(PT|PST|PDT|UTC|GMT)?"
    part = lambda p, i: F.regexp_extract(s, p, i)
    number = lambda p, i: F.coalesce(part(p, i).try_cast("int"), F.lit(0))
    zoned = _stamp(part(day, 1).try_cast("int"), part(day, 2).try_cast("int"), part(day, 3).try_cast("int"), number(day, 4), number(day, 5))
    zoned = F.when(part(day, 6).startswith("P"), F.to_utc_timestamp(zoned, PACIFIC)).otherwise(zoned)
    american = rf"(?i)\b({_NAMES})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})"
    british = rf"(?i)(\d{{1,2}})\s+({_NAMES})\.?,?\s+(\d{{4}})"
    slashes = r"(\d{1,2})/(\d{1,2})/(\d{4})"
    return (
        F.when(iso.isNotNull(), iso)
        .when(s.rlike(day), zoned)
        .when(s.rlike(american), _stamp(part(american, 3).try_cast("int"), _month(part(american, 1)), part(american, 2).try_cast("int")))
        .when(s.rlike(british), _stamp(part(british, 3).try_cast("int"), _month(part(british, 2)), part(british, 1).try_cast("int")))
        .when(s.rlike(slashes), _stamp(part(slashes, 3).try_cast("int"), part(slashes, 1).try_cast("int"), part(slashes, 2).try_cast("int")))
    )


def local_day(ts: Column, zone: str = "Europe/Istanbul") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def in_quiet_hours(ts: Column, start: str, end: str, zone: str = "Europe/Istanbul") -> Column:
    """Whether the local time lies from start to before end, over midnight too; never if both are equal."""
    local = F.from_utc_timestamp(ts, zone)
    now = F.hour(local) * 60 + F.minute(local)
    s, e = (int(h) * 60 + int(m) for h, m in (x.split(":") for x in (start, end)))
    if s == e:
        return ts.isNull() & F.lit(False)
    return (now >= s) & (now < e) if s < e else (now >= s) | (now < e)


def age_label(ts: Column, now: Column) -> Column:
    """now, n min, n h or n days; unknown for null."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(ts)
    return (
        F.when(ts.isNull(), "unknown")
        .when(seconds < 90, "now")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" days")))
    )


def _named(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), n)


def long_label(ts: Column, with_time: bool = True, zone: str = "Europe/Istanbul") -> Column:
    """'26 Eylül 2026 08:00' in a zone; a dash for null."""
    local = F.from_utc_timestamp(ts, zone)
    parts = [F.dayofmonth(local).cast("string"), _named(fixed.MONTHS_TR, F.month(local)), F.year(local).cast("string")]
    parts += [F.date_format(local, "HH:mm")] if with_time else []
    return F.when(ts.isNull(), "—").otherwise(F.concat_ws(" ", *parts))


def day_label(day: Column) -> Column:
    """'26 Eylül 2026, Cumartesi'; null for null."""
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), _named(fixed.MONTHS_TR, F.month(day)), F.lit(" "), F.year(day).cast("string"), F.lit(", "), _named(fixed.DAYS_TR, F.weekday(day) + 1))


def support_bucket(days_left: Column) -> Column:
    out = F.when(days_left.isNull(), "unknown").when(days_left < 0, "ended")
    for limit in (7, 30, 90, 180):
        out = out.when(days_left <= limit, f"<={limit}")
    return out.otherwise(">180")


def source_bucket(n: Column) -> Column:
    return F.when(n >= 5, 5).when(n >= 2, 2).when(n >= 1, 1).otherwise(0)


def is_due_day(ts: Column, weekend: bool, zone: str = "Europe/Istanbul") -> Column:
    return F.lit(True) if weekend else F.weekday(F.from_utc_timestamp(ts, zone)) < 5


def is_stale(module: Column, data_time: Column, now: Column, hours: dict[str, int]) -> Column:
    """Whether data are older than their module's limit; no limit or no time: not known to be fresh, so stale."""
    limits = F.create_map(*(x for m, h in hours.items() for x in (F.lit(m), F.lit(h))))
    age = (F.unix_timestamp(now) - F.unix_timestamp(data_time)) / 3600
    return F.coalesce(age > limits[module], F.lit(True))


def is_patch_tuesday(day: Column) -> Column:
    return (F.weekday(day) == 1) & F.dayofmonth(day).between(8, 14)

"""Quotes and their comparison, places, agendas, budgets of prompts, grounding of generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnline.functions import fixed, text
from dawnline.operators.ordered import with_previous


def compared(quotes: DataFrame, keys: list[str], at: str, tie: str, price: str) -> DataFrame:
    """Each quote with the one before of its keys: difference (4 digits) and percent (2), null at equal times or from 0."""
    rows = with_previous(quotes, keys, [F.col(at), F.col(tie)], [price, at], "_p_")
    before, was = F.col(f"_p_{price}"), F.col(f"_p_{at}")
    diff = F.when((was != F.col(at)) & (before != 0), F.col(price) - before)
    return rows.withColumns({"previous": before, "diff": F.round(diff, 4), "pct": F.round(diff / before * 100, 2)}).drop(f"_p_{price}", f"_p_{at}")


def previous_used(sets: DataFrame, used: DataFrame, key: str, order: str) -> DataFrame:
    """Each set with the latest set before it that is in used."""
    marked = sets.join(used.select(key).distinct().withColumn("_used", F.lit(True)), key, "left")
    # one row per set of quotes: few enough for one running window
    part = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("previous", F.last(F.when(F.col("_used"), F.col(key)), ignorenulls=True).over(part)).drop("_used")


def completeness(wanted: Column, present: Column) -> Column:
    """struct of kept, missing and status (ok, partial, error): missing items are listed and never derived."""
    kept, missing = F.array_intersect(wanted, present), F.array_except(wanted, present)
    status = F.when(F.size(missing) == 0, "ok").when(F.size(kept) > 0, "partial").otherwise("error")
    return F.struct(F.array_sort(kept).alias("kept"), F.array_sort(missing).alias("missing"), status.alias("status"))


def overlapping(intervals: DataFrame, days: DataFrame, start: str, end: str, day: str, hours: int = 24) -> DataFrame:
    """Intervals with each day that they overlap, to the microsecond. An interval is sent to the days that it touches and joined by equality."""
    length = F.lit(hours * 3600 * 1_000_000)

    def slot(at: str, before: int = 0) -> Column:
        micros = F.unix_micros(F.col(at).cast("timestamp")) - before
        return ((micros - F.pmod(micros, length)) / length).cast("long")

    first, last = slot(start), slot(end, before=1)
    spread = intervals.withColumn("_slot", F.explode(F.sequence(first, F.greatest(first, last))))
    slots = days.withColumn("_slot", slot(day))
    return spread.join(slots, "_slot").drop("_slot")


def ungrounded(claims: Column, evidence: Column) -> Column:
    """The identifiers of a generated text that its evidence lacks; empty if it may stand."""
    return F.array_except(claims, evidence)


def uncached(prompts: DataFrame, cache: DataFrame, prompt: str, key: str = "prompt_hash") -> DataFrame:
    return prompts.withColumn(key, F.sha2(prompt, 256)).join(cache.select(key), key, "left_anti")


def bundle(evidence: DataFrame, event: str, official: str, order: str, title: str, body: str, top: int = 6, chars: int = 2200) -> DataFrame:
    """One prompt text per event: its first sources, official ones first, cut before they are gathered."""
    w = Window.partitionBy(event).orderBy(F.desc(official), order)
    few = evidence.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    part = F.concat_ws("\n", F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), F.coalesce(title, F.lit(""))), F.substring(F.coalesce(body, F.lit("")), 1, chars))
    parts = F.sort_array(F.collect_list(F.struct("_n", part.alias("part"))))
    return few.groupBy(event).agg(F.array_join(parts["part"], "\n\n").alias("prompt"), F.count("*").alias("sources"))


def ranked_places(places: DataFrame, position: str, name: str, where: str = "", count: int = 10) -> DataFrame:
    """The first places by a name: those so called first, then seats of an administration, then as they were listed.

    places: position, name, admin1, admin2, country, feature_code. where keeps places of which a part of an administration or
    the country is so called. Names are compared folded. The few that a reader is shown come from a take-ordered plan.
    """
    folded = text.fold("name")
    if where:
        within = [F.contains(text.fold(c), text.fold(F.lit(where))) for c in ("admin1", "admin2", "country")]
        places = places.where(within[0] | within[1] | within[2])
    district = text.fold(F.regexp_replace(F.coalesce("admin2", F.lit("")), fixed.DISTRICT_ENDING, ""))
    seat = F.coalesce(F.col("feature_code").isin(fixed.SEAT_CODES), F.lit(False)) | (folded == district)
    return places.withColumns({"exact": folded == text.fold(F.lit(name)), "seat": seat}).orderBy(F.desc("exact"), F.desc("seat"), position).limit(count)

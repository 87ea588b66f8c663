"""Labels read from texts: states, stages, kinds and types; the first rule that fits decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dawnline.functions import dates, fixed
from dawnline.sources import markdown


def first_rule(value: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first (pattern, label) rule that a lower-cased text fits."""
    low, out = F.lower(F.coalesce(value, F.lit(""))), F.when(F.lit(False), "")
    for pattern, label in rules:
        out = out.when(low.rlike(pattern), label)
    return out.otherwise(otherwise)


def status(raw: Column) -> Column:
    return first_rule(raw, fixed.STATUS_RULES, "unknown")


def hotfix_type(title: Column) -> Column:
    return first_rule(title, fixed.HOTFIX_RULES, "hotfix")


def change_kind(title: Column, body: Column, page: Column | None = None) -> Column:
    """deprecation, change or feature; whatever stands on the notices page and is no deprecation is a change."""
    told = first_rule(F.concat_ws(" ", title, F.substring(body, 1, 800)), fixed.CHANGE_RULES, "feature")
    return told if page is None else F.when((page == "notices") & (told == "feature"), "change").otherwise(told)


def stage(title: Column, body: Column, page: Column | None = None) -> Column:
    """in_development and notice by the page; else public_preview or ga by the text."""
    told = first_rule(F.concat_ws(" ", title, F.substring(body, 1, 600)), fixed.STAGE_RULES, "ga")
    return told if page is None else F.when(page == "in_development", "in_development").when(page == "notices", "notice").otherwise(told)


def _first_match(text: Column, pattern: str, chars: int) -> Column:
    # no sentence is begun in its middle: from there, nothing is found that is not found from its start, which comes first
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?<![^.\n])" + pattern, 0)
    return F.substring(F.trim(F.regexp_replace(found, r"\s+", " ")), 1, chars)


def licence_note(body: Column) -> Column:
    """The first sentence that speaks of a licence, at most 400 characters; empty if none does."""
    return _first_match(body, fixed.LICENCE_NOTE, 400)


def rollout_note(body: Column) -> Column:
    return _first_match(body, fixed.ROLLOUT_NOTE, 400)


def admin_action(md: Column) -> Column:
    """What follows the question how to prepare, up to the next heading, as plain text of at most 1,200 characters."""
    found = F.regexp_extract(F.coalesce(md, F.lit("")), fixed.ADMIN_ACTION, 1)
    return F.substring(F.trim(F.regexp_replace(markdown.to_text(found), r"\s+", " ")), 1, 1200)


def platforms(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(name)) for name, p in fixed.PLATFORMS.items())))


def release_type(title: Column, hotpatch: Column, day: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(low.rlike("out-of-band|out of band"), "oob").when(hotpatch, "hotpatch").when(low.rlike(r"\bpreview\b"), "preview")
        .when(F.coalesce(dates.is_patch_tuesday(day), F.lit(False)), "security").otherwise("other")
    )

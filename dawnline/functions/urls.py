"""URLs: canonical form, registrable domain, trust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dawnline.functions import fixed

_TRACKING = r"[?&](?:utm_[^=&]+|fbclid|gclid|ref|cmpid|at_[a-z_]+)=[^&#]*"


def canonical(url: Column) -> Column:
    """Without tracking parameters. Kept as is: where the first parameter goes, '&' stays before the next one."""
    return F.regexp_replace(F.replace(F.regexp_replace(url, _TRACKING, ""), F.lit("?&"), F.lit("?")), r"\?+$", "")


def host(url: Column) -> Column:
    """Lower-cased host without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def registrable_domain(url: Column) -> Column:
    parts = F.split(host(url), r"\.")
    n = F.size(parts)
    second = F.when(n >= 3, F.element_at(parts, -2)).isin(fixed.SECOND_LEVELS) & (F.length(F.element_at(parts, -1)) == 2)
    return (
        F.when((n >= 3) & second, F.array_join(F.slice(parts, -3, 3), "."))
        .when(n >= 2, F.array_join(F.slice(parts, -2, 2), "."))
        .otherwise(host(url))
    )


def trust_of_url(url: Column) -> Column:
    """official, community, press or unknown, the first pattern that fits."""
    text = F.coalesce(url, F.lit(""))
    board = F.lower(F.coalesce(F.nullif(F.regexp_extract(text, fixed.BLOG_PAGE, 2), F.lit("")), F.regexp_extract(text, fixed.BLOG_PAGE, 1)))
    out = F.when(F.lit(False), "")
    for pattern in fixed.COMMUNITY_PAGES:
        out = out.when(text.rlike(pattern), "community")
    out = out.when(text.rlike(fixed.BLOG_PAGE), F.when(board.isin(fixed.OFFICIAL_BOARDS), "official").otherwise("community"))
    for pattern in fixed.OFFICIAL_PAGES:
        out = out.when(text.rlike(pattern), "official")
    return out.when(registrable_domain(url).isin(fixed.PRESS_DOMAINS), "press").otherwise("unknown")


def effective_trust(source_trust: Column, url: Column) -> Column:
    """The source's trust under the page's: a community page is never official."""
    by_url = trust_of_url(url)
    return (
        F.when(by_url == "community", "community")
        .when(source_trust == "official", F.when(by_url.isin("official", "unknown"), "official").otherwise(by_url))
        .when(source_trust.isin("unknown", "user"), by_url)
        .otherwise(source_trust)
    )


def evidence_level(kind: Column, trust: Column) -> Column:
    known = kind.isin("known_issue", "cm_known_issue")
    return F.when(trust == "official", F.when(known, "ms_known_issue").otherwise("ms_official")).otherwise("field")


def is_safe(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(r"(?i)^https?://"), F.lit(False))

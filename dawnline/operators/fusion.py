"""States fused from evidence, their differences, versions and scores."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnline.functions import dates, fixed, text


@dataclass(frozen=True)
class Profile:
    """What a reader runs and looks for."""

    products: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    version: str | None = None
    tracks: list[str] = field(default_factory=list)
    platforms: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)


def _tiered(sets: list[str], tiers: list[Column]) -> list[Column]:
    """Aggregates that unite each set column over the rows of every tier, so that one pass serves whatever tier comes out on top."""
    return [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(tier, F.col(c)))))).alias(f"{c}_{i}") for c in sets for i, tier in enumerate(tiers)]


def _of_tier(name: str, top: Column, tiers: int) -> Column:
    return F.element_at(F.array(*(F.col(f"{name}_{i}") for i in range(tiers))), (top + 1).cast("int")).alias(name)


def united(rows: DataFrame, key: str, sets: dict[str, Column]) -> DataFrame:
    """key and, by name, the sorted union of each array over the key's rows.

    Values are made distinct as rows of their own, with partial aggregation, so that a hot key sends each value once a task
    and only its distinct values meet.
    """
    none = F.array().cast("array<struct<k: int, v: string>>")
    named = lambda i, c: F.coalesce(F.transform(c, lambda v: F.struct(F.lit(i).alias("k"), v.alias("v"))), none)
    each = rows.select(key, F.inline(F.concat(*(named(i, c) for i, c in enumerate(sets.values()))))).distinct()
    lists = each.groupBy(key).agg(F.collect_list(F.struct("k", "v")).alias("_each"))
    of = lambda i: F.array_sort(F.transform(F.filter("_each", lambda x: x["k"] == i), lambda x: x["v"]))
    return lists.select(key, *(of(i).alias(name) for i, name in enumerate(sets)))


def issue_states(evidence: DataFrame, event: str, independent: DataFrame | None = None) -> DataFrame:
    """The state of each issue event, from its evidence rows; only the strongest level of evidence adds to the sets.

    evidence: event, id, level (of fixed.EVIDENCES), health (boolean: a status page's own record), status, updated, kind, kb,
    kbs, products, tags, versions, originating_kbs, resolving_kbs, partial_fix_kbs (arrays), workaround, rollback.
    independent: event and independent, the number of independent reports.
    """
    level = F.array_position(F.array(*map(F.lit, fixed.EVIDENCES)), F.col("level")) - 1
    rows = evidence.withColumn("_level", level.cast("int"))
    # one number an event goes back to its rows, so that what weaker levels say is dropped before sets are made
    tops = rows.groupBy(event).agg(F.max("_level").alias("_top"))
    strong = rows.join(tops, event).where("_level = _top")
    official, nothing = F.col("_top") > 0, F.array().cast("array<string>")
    own = F.when(F.size("originating_kbs") > 0, F.col("originating_kbs")).when(F.col("kb").isNotNull() & (F.col("kind") == "known_issue"), F.array("kb")).otherwise(nothing)
    told = official & (F.trim("workaround") != "")
    sets = {
        "products": F.col("products"), "tags": F.col("tags"), "versions": F.col("versions"), "originating_kbs": F.when(official, own).otherwise(F.array_union(own, F.coalesce("kbs", nothing))),
        "resolving_kbs": F.when(official, F.col("resolving_kbs")), "partial_fix_kbs": F.when(official, F.col("partial_fix_kbs")), "workaround_tokens": F.when(told, text.token_set("workaround", noise=fixed.DOMAIN_NOISE)),
    }
    newest = F.struct(F.col("health").cast("int"), F.coalesce("updated", F.lit("")), "id")
    found = strong.groupBy(event).agg(F.max("_top").alias("_top"), F.max_by("status", newest).alias("_status"), F.coalesce(F.bool_or(told), F.lit(False)).alias("_told"), F.coalesce(F.bool_or(official & F.col("rollback")), F.lit(False)).alias("kir"))
    found = found.join(united(strong, event, sets), event, "left")
    status = F.when(F.col("_top") == 2, F.coalesce(F.nullif("_status", F.lit("unknown")), F.lit("confirmed"))).when(F.col("_top") == 1, "confirmed").otherwise("reported")
    name = F.element_at(F.array(*map(F.lit, fixed.EVIDENCES)), F.col("_top") + 1)
    out = found.select(event, name.alias("evidence"), status.alias("status"), "kir", "_told", *(F.coalesce(c, nothing).alias(c) for c in sets))
    counts = independent.select(event, F.col("independent").alias("field_sources")) if independent is not None else None
    out = out.join(counts, event, "left") if counts is not None else out.withColumn("field_sources", F.lit(0))
    out = out.withColumns({
        "field_bucket": dates.source_bucket(F.coalesce("field_sources", F.lit(0))), "workaround": F.col("_told") | F.col("kir"), "partial_fix_kbs": F.array_except("partial_fix_kbs", "resolving_kbs"),
        "fix": F.col("status").isin(fixed.RESOLVED) | (F.size("resolving_kbs") > 0),
    })
    servers = [p for p, family, _ in fixed.PRODUCTS if family == "server"]
    server = F.arrays_overlap("products", F.array(*map(F.lit, servers)))
    return out.drop("_told").withColumn("risk", risk_of_issue(F.col("tags"), server, F.col("status"), F.col("workaround")))


def main_states(records: DataFrame, event: str) -> DataFrame:
    """The state of each release, feature, notice, version or hotfix event: its newest official record, with unions over all official ones.

    records: event, id, kind (of the event), official, at (string), announcement, kb, release_type, expired, stage, change_kind,
    admin_action, license, version, track, supported, days_left, hotfix_type, products, builds, platforms, versions. Events
    without an official record are told by all their records. Fields of other kinds are null.
    """
    tiers = [~F.col("official"), F.col("official")]
    newest = F.struct("official", F.coalesce("at", F.lit("")), "id")
    fields = ["kind", "announcement", "kb", "release_type", "stage", "change_kind", "license", "version", "track", "supported", "days_left", "hotfix_type", "versions"]
    flags = [F.coalesce(F.bool_or(t & F.col(c)), F.lit(False)).alias(f"{c}_{i}") for c in ("expired", "admin_action") for i, t in enumerate(tiers)]
    found = records.groupBy(event).agg(F.max_by(F.struct(*fields), newest).alias("m"), F.max(F.col("official").cast("int")).alias("_top"), *_tiered(["products", "builds", "platforms"], tiers), *flags)
    top, kind = F.col("_top"), F.col("m.kind")
    notice = F.coalesce(F.col("m.announcement"), F.lit(False)) & kind.isin("feature", "notice")
    told = kind.isin("feature", "notice")
    only = lambda where, c: F.when(where, c)
    pick = lambda c: _of_tier(c, top, 2)
    out = found.select(
        event, F.when(notice, "notice").otherwise(kind).alias("kind"),
        only(kind.isin("release", "hotfix"), F.col("m.kb")).alias("kb"), only(kind == "release", F.col("m.release_type")).alias("release_type"),
        only(kind == "release", pick("products")).alias("products"), only(kind == "release", pick("builds")).alias("builds"), only(kind == "release", pick("expired")).alias("expired"),
        only(told, F.when(notice, "notice").otherwise(F.col("m.stage"))).alias("stage"), only(told, F.when(notice, "announcement").otherwise(F.col("m.change_kind"))).alias("change_kind"),
        only(told, F.when(notice, F.array().cast("array<string>")).otherwise(pick("platforms"))).alias("platforms"),
        only(told, ~notice & pick("admin_action")).alias("admin_action"), only(told, ~notice & F.coalesce("m.license", F.lit(False))).alias("license"),
        only(kind == "version", F.col("m.version")).alias("version"), only(kind == "version", F.col("m.track")).alias("track"),
        only(kind == "version", F.coalesce("m.supported", F.lit(True))).alias("supported"), only(kind == "version", dates.support_bucket(F.col("m.days_left"))).alias("support_bucket"),
        only(kind == "hotfix", F.array_sort("m.versions")).alias("versions"), only(kind == "hotfix", F.col("m.hotfix_type")).alias("hotfix_type"),
    )
    return out.withColumn("risk", risk_of_other(*(F.col(c) for c in ("kind", "release_type", "expired", "track", "support_bucket", "hotfix_type", "change_kind", "admin_action"))))


def risk_of_issue(tags: Column, server: Column, status: Column, workaround: Column) -> Column:
    """critical, high, medium or low by what the tags hit, on what, and whether it is resolved or mitigated."""
    impact = F.when(F.lit(False), 0.0)
    for names, points in fixed.TAG_IMPACTS:
        impact = impact.when(F.arrays_overlap(tags, F.array(*map(F.lit, names))), points)
    impact = impact.when(F.size(tags) > 0, fixed.OTHER_TAG_IMPACT).otherwise(fixed.NO_TAG_IMPACT) + F.when(server, fixed.SERVER_IMPACT).otherwise(0.0)
    impact = impact - F.when(status.isin(fixed.RESOLVED), fixed.RESOLVED_RELIEF).when(status.isin(fixed.MITIGATED) | workaround, fixed.MITIGATED_RELIEF).otherwise(0.0)
    level = F.when(F.lit(False), "")
    for least, name in fixed.RISK_FROM:
        level = level.when(impact >= least, name)
    return level.otherwise("low")


def risk_of_other(kind: Column, release_type: Column, expired: Column, track: Column, support: Column, hotfix_type: Column, change_kind: Column, admin_action: Column) -> Column:
    """The risk of releases, versions, hotfixes, features and notices; null for other kinds."""
    by = lambda value, table: F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[value], F.lit("low"))
    return (
        F.when(kind == "release", F.when(expired, "high").otherwise(by(release_type, fixed.RELEASE_RISKS)))
        .when(kind == "version", F.when(track == "tp", "low").otherwise(by(support, fixed.SUPPORT_RISKS)))
        .when(kind == "hotfix", by(hotfix_type, fixed.HOTFIX_RISKS))
        .when(kind.isin("feature", "notice"), F.when((change_kind == "deprecation") | admin_action, "medium").otherwise("low"))
    )


#: The columns of a state that differences are told by; a state need not have all of them.
STATE = {
    "evidence": "string", "status": "string", "products": "array<string>", "tags": "array<string>", "originating_kbs": "array<string>", "workaround": "boolean", "kir": "boolean",
    "workaround_tokens": "array<string>", "resolving_kbs": "array<string>", "partial_fix_kbs": "array<string>", "field_bucket": "int", "release_type": "string", "expired": "boolean",
    "stage": "string", "change_kind": "string", "admin_action": "boolean", "platforms": "array<string>", "support_bucket": "string", "hotfix_type": "string", "versions": "array<string>", "risk": "string",
}


def difference(old: DataFrame, new: DataFrame, event: str, kind: str = "kind") -> DataFrame:
    """changes (names, in order, once each) and material of each event's new state against its old one; a new event is material.

    States have kind and columns of STATE; what a state lacks counts as null.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        columns = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in STATE.items()]
        return df.select(event, F.struct(F.col(kind).alias("kind"), *columns).alias(name))

    both = packed(new, "n").join(packed(old, "o"), event, "left")
    c = F.col
    none = F.array().cast("array<string>")
    items = lambda side, name: F.coalesce(c(f"{side}.{name}"), none)
    some = lambda name, by="n", than="o": F.size(F.array_except(items(by, name), items(than, name))) > 0
    yes = lambda x: F.coalesce(x, F.lit(False))
    newly = lambda name: yes(c(f"n.{name}")) & ~yes(c(f"o.{name}"))
    differs = lambda name: ~c(f"n.{name}").eqNullSafe(c(f"o.{name}"))
    rank = lambda side, name, order: F.nullif(F.array_position(F.array(*map(F.lit, order)), c(f"{side}.{name}")), F.lit(0).cast("long"))
    was, now = yes(c("o.status").isin(fixed.RESOLVED)), yes(c("n.status").isin(fixed.RESOLVED))
    eased = yes(c("n.status").isin(fixed.MITIGATED)) & ~yes(c("o.status").isin(fixed.MITIGATED)) & ~now & ~was
    tags = lambda side: text.specific_tags(items(side, "tags"))
    reworded = yes(c("n.workaround")) & yes(c("o.workaround")) & ~newly("kir") & (text.jaccard(items("o", "workaround_tokens"), items("n", "workaround_tokens")) < 0.5)
    partial = F.array_except(F.array_except(items("n", "partial_fix_kbs"), items("o", "partial_fix_kbs")), F.array_except(items("n", "resolving_kbs"), items("o", "resolving_kbs")))
    spread = (c("n.evidence") == "field") & (F.coalesce("n.field_bucket", F.lit(0)) > c("o.field_bucket")) & (c("o.field_bucket") > 0)
    step = rank("n", "risk", fixed.RISKS) - rank("o", "risk", fixed.RISKS)
    of = lambda *kinds: c("n.kind").isin(*kinds)
    issue, release, told = of("issue"), of("release"), of("feature", "notice")
    #: The names of the changes; then whether a change makes a new version.
    rules = [
        (issue & (rank("n", "evidence", fixed.EVIDENCES) > rank("o", "evidence", fixed.EVIDENCES)), "ms_confirmed", True),
        (issue & now & ~was, "fix", True),
        (issue & was & ~now, "reopened", True),
        (issue & eased, "workaround", True),
        (issue & differs("status") & (now == was) & ~eased, "status", False),
        (issue & some("products"), "scope_expanded", True),
        (issue & some("products", "o", "n") & ~some("products"), "correction", True),
        (issue & (F.size(F.array_except(tags("n"), tags("o"))) > 0) & (F.size(items("o", "tags")) > 0), "scope_expanded", True),
        (issue & some("originating_kbs") & (F.size(items("o", "originating_kbs")) > 0), "scope_expanded", True),
        (issue & (newly("workaround") | newly("kir")), "workaround", True),
        (issue & reworded, "workaround_updated", True),
        (issue & some("resolving_kbs"), "fix", True),
        (issue & (F.size(partial) > 0), "partial_fix", True),
        (issue & spread, "spread", True),
        (release & differs("release_type"), "correction", True),
        (release & newly("expired"), "pulled", True),
        (release & some("products"), "scope", False),
        (told & differs("stage"), "stage_changed", True),
        (told & (c("n.change_kind") == "deprecation") & ~yes(c("o.change_kind") == "deprecation"), "deprecation", True),
        (told & newly("admin_action"), "action_required", True),
        (told & some("platforms"), "scope", False),
        (of("version") & differs("support_bucket") & ((c("n.support_bucket") == "ended") | c("n.support_bucket").startswith("<=")), "support_ending", True),
        (of("hotfix") & differs("hotfix_type"), "correction", True),
        (of("hotfix") & some("versions"), "scope", False),
        ((step != 0) & ((step > 0) | issue), "risk_changed", True),
        ((step < 0) & ~issue, "risk_changed", False),
    ]
    isnew = c("o").isNull()
    changes = F.array_distinct(F.array_compact(F.array(*(F.when(yes(when), F.lit(name)) for when, name, _ in rules))))
    material = reduce(Column.__or__, (yes(when) for when, _, matters in rules if matters))
    return both.select(event, F.when(isnew, F.array(F.lit("new"))).otherwise(changes).alias("changes"), (isnew | material).alias("material"))


def _lits(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def relevance(module: Column, kind: Column, state: dict[str, Column], profile: Profile, followed: Column, told: Column) -> Column:
    """How much an event concerns a reader. state: products, tags, versions, platforms (arrays), version, track, hotfix_type.

    told is the text in which the reader's words are looked for. An issue of other versions only than the reader's scores
    nothing but being followed.
    """
    windows, manager = module == "windows", module == "configmgr"
    versions, own = F.coalesce(state["versions"], _lits([])), profile.version
    mine = F.arrays_overlap(F.coalesce(state["products"], _lits([])), _lits(profile.products)) if profile.products else F.lit(False)
    score = F.when(mine, 2.0).when(windows & F.lit(not profile.products), 0.5).otherwise(0.0)
    roles = sorted({t for role in profile.roles for t in fixed.ROLE_TAGS.get(role, [])})
    score = score + F.when(windows & F.arrays_overlap(F.coalesce(state["tags"], _lits([])), _lits(roles)), 1.5).otherwise(0.0)
    is_version, is_hotfix = kind == "version", kind == "hotfix"
    newer = F.coalesce(F.array_max(versions) > F.lit(own), F.lit(False)) if own else F.lit(False)
    fits = F.array_contains(versions, own) if own else F.lit(False)
    part = F.when(is_version & (state["version"] == F.lit(own)), 3.0) if own else F.when(F.lit(False), 0.0)
    part = (
        part.when(is_hotfix & fits, 2.0).when(is_hotfix & state["hotfix_type"].isin("summary", "early_ring") & newer, 0.5)
        .when(is_version & (state["track"] == "tp") & F.lit("tp" in profile.tracks), 0.5).when(F.lit(not own), 0.5).otherwise(0.0)
    )
    other = manager & (kind == "issue") & (F.size(versions) > 0) & ~fits if own else F.lit(False)
    score = score + F.when(manager, part).otherwise(0.0)
    platforms = F.coalesce(state["platforms"], _lits([]))
    full = score + F.when((module == "intune") & ((F.size(platforms) == 0) | F.arrays_overlap(platforms, _lits(profile.platforms))), 1.0).otherwise(0.0)
    full = full + F.when(followed, 3.0).otherwise(0.0)
    folded = text.fold(told)
    for words, points in ((profile.keywords, 1.0), (profile.excluded, -100.0)):
        for word in filter(None, words):
            full = full + F.when(F.contains(folded, text.fold(F.lit(word))), points).otherwise(0.0)
    return F.when(other, F.least(score, F.lit(0.0)) + F.when(followed, 3.0).otherwise(0.0)).otherwise(full)

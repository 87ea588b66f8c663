"""States of events fused from evidence, what changes between two dates, versions, risk and relevance; order lines are the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnline.functions import fixed
from dawnline.operators import folding, fusion
from dawnline.plans.tables import Registry, table

R = Registry()

_PRODUCTS = ["ws2025", "win11-24h2", "ws2019", "win10-22h2"]
_TAGS = ["auth", "rds", "vpn", "security", "audio", "performance"]
_FIXES = ["driver", "cable", "queue", "spooler", "cache"]
_KINDS = ["release", "feature", "notice", "version", "hotfix"]


def _pick(values: list, n: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql_pick(values: list, n: str) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + f"][({n})%{len(values)}+1]"


def _number(n: F.Column) -> F.Column:
    return n.cast("long").cast("string")


_ID = "(cast(l_linenumber as bigint)*100000000+l_partkey*1000+l_suppkey%1000)"


def _evidence(lines: DataFrame) -> DataFrame:
    c = F.col
    none = F.array().cast("array<string>")
    some = lambda when, value: F.when(when, F.array(value)).otherwise(none)
    return lines.select(
        c("l_orderkey").alias("event"), (c("l_linenumber").cast("long") * 100000000 + c("l_partkey") * 1000 + c("l_suppkey") % 1000).alias("id"),
        F.when(c("l_returnflag") == "R", "ms_known_issue").when(c("l_returnflag") == "A", "ms_official").otherwise("field").alias("level"), (c("l_linestatus") == "O").alias("health"),
        _pick(["unknown", "resolved", "mitigated", "confirmed"], c("l_linenumber")).alias("status"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("updated"),
        _pick(["known_issue", "notice"], c("l_partkey")).alias("kind"), F.when(c("l_suppkey") % 3 == 0, _number(5000000 + c("l_partkey") % 1000)).alias("kb"), F.array(_number(6000000 + c("l_suppkey"))).alias("kbs"),
        F.array(_pick(_PRODUCTS, c("l_partkey"))).alias("products"), F.array(_pick(_TAGS, c("l_suppkey"))).alias("tags"), F.array(_number(2400 + c("l_linenumber"))).alias("versions"),
        some(c("l_discount") > 0.05, _number(5000000 + c("l_partkey") % 500)).alias("originating_kbs"), some(c("l_tax") > 0.06, _number(7000000 + c("l_partkey") % 3)).alias("resolving_kbs"),
        some(c("l_tax") > 0.04, _number(7000000 + c("l_suppkey") % 3)).alias("partial_fix_kbs"), F.when(c("l_quantity") > 40, F.concat(F.lit("Restart the "), _pick(_FIXES, c("l_partkey")))).alias("workaround"),
        (c("l_discount") >= 0.1).alias("rollback"), "l_shipdate", "l_suppkey",
    )


def _issues(lines: DataFrame) -> DataFrame:
    rows = _evidence(lines)
    reports = rows.groupBy("event").agg(F.count_distinct(F.when(F.col("level") == "field", F.col("l_suppkey"))).alias("independent"))
    return fusion.issue_states(rows, "event", reports)


def _union(c: str) -> str:
    return f"list_sort(list_distinct(flatten(list({c}))))"


_RISK_SQL = (
    "case when list_contains(tags,'security') then 3.5 when "
    + " when ".join(f"list_has_any(tags, {names}) then {points}" for names, points in fixed.TAG_IMPACTS[1:])
    + " when len(tags)>0 then 1.5 else 1.25 end + case when list_has_any(products,['ws2025','ws2022','ws23h2','ws2019','ws2016']) then 0.25 else 0 end - case when status in ('resolved','resolved_external') then 1.5 when status in ('mitigated','mitigated_external') or workaround then 0.25 else 0 end"
)


def _sql_issues(where: str = "true") -> str:
    return f"""with e as (select l_orderkey as event, {_ID} as id, case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end as tier, l_linestatus='O' as health, {_sql_pick(['unknown', 'resolved', 'mitigated', 'confirmed'], 'l_linenumber')} as status,
strftime(l_shipdate,'%Y-%m-%d') as updated, {_sql_pick(['known_issue', 'notice'], 'l_partkey')} as kind, case when l_suppkey%3=0 then cast(5000000+l_partkey%1000 as varchar) end as kb, cast(6000000+l_suppkey as varchar) as report, {_sql_pick(_PRODUCTS, 'l_partkey')} as product, {_sql_pick(_TAGS, 'l_suppkey')} as tag,
cast(2400+l_linenumber as varchar) as version, case when l_discount>0.05 then cast(5000000+l_partkey%500 as varchar) end as orig, case when l_tax>0.06 then cast(7000000+l_partkey%3 as varchar) end as res, case when l_tax>0.04 then cast(7000000+l_suppkey%3 as varchar) end as part, case when l_quantity>40 then {_sql_pick(_FIXES, 'l_partkey')} end as wa, l_discount>=0.1 as rb, l_suppkey from lineitem where {where}),
t as (select *, max(tier) over (partition by event) as top from e), r as (select event, count(distinct case when tier=0 then l_suppkey end) as n from e group by 1),
g as (select event, any_value(top) as top, arg_max(status, struct_pack(h:=health::int,u:=updated,i:=id)) as st, list_sort(list_distinct(list(product))) as products, list_sort(list_distinct(list(tag))) as tags, list_sort(list_distinct(list(version))) as versions,
{_union("case when orig is not null then [orig] when kb is not null and kind='known_issue' then [kb] else []::varchar[] end || case when tier=0 then [report] else []::varchar[] end")} as originating_kbs,
{_union("case when tier>0 and res is not null then [res] else []::varchar[] end")} as resolving_kbs, {_union("case when tier>0 and part is not null then [part] else []::varchar[] end")} as parts,
{_union("case when tier>0 and wa is not null then ['resta', substr(wa,1,5)] else []::varchar[] end")} as workaround_tokens, bool_or(tier>0 and rb) as kir from t where tier=top group by event),
s as (select g.event, 'issue' as kind, ['field','ms_official','ms_known_issue'][top+1] as evidence, case top when 2 then case st when 'unknown' then 'confirmed' else st end when 1 then 'confirmed' else 'reported' end as status, products, tags, versions, originating_kbs, resolving_kbs,
list_sort(list_filter(parts, lambda x: not list_contains(resolving_kbs, x))) as partial_fix_kbs, len(workaround_tokens)>0 or kir as workaround, kir, workaround_tokens, n as field_sources, case when n>=5 then 5 when n>=2 then 2 when n>=1 then 1 else 0 end as field_bucket from g join r using (event)),
i as (select *, status in ('resolved','resolved_external') or len(resolving_kbs)>0 as fix, {_RISK_SQL} as impact from s)
select * exclude (impact), case when impact>=3.25 then 'critical' when impact>=2.5 then 'high' when impact>=1.75 then 'medium' else 'low' end as risk from i"""


@R.query(f"select * exclude (kind) from ({_sql_issues()})")
def a1_issue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as evidence: only the strongest level counts, fixes and workarounds only from official rows."""
    return _issues(table(spark, sf_dir, "lineitem"))


def _records(lines: DataFrame) -> DataFrame:
    c = F.col
    return lines.select(
        c("l_orderkey").alias("event"), (c("l_linenumber").cast("long") * 100000000 + c("l_partkey") * 1000 + c("l_suppkey") % 1000).alias("id"), _pick(_KINDS, c("l_orderkey")).alias("kind"),
        (c("l_returnflag") != "N").alias("official"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"), (c("l_linenumber") == 1).alias("announcement"), _number(5000000 + c("l_partkey") % 1000).alias("kb"),
        _pick(["oob", "security", "preview", "hotpatch"], c("l_partkey")).alias("release_type"), (c("l_discount") >= 0.1).alias("expired"), _pick(["ga", "public_preview", "in_development"], c("l_suppkey")).alias("stage"),
        _pick(["deprecation", "change", "feature", "feature"], c("l_suppkey")).alias("change_kind"), (c("l_quantity") > 45).alias("admin_action"), (c("l_tax") > 0.05).alias("license"), _number(2400 + c("l_linenumber")).alias("version"),
        _pick(["tp", "cb", "cb"], c("l_partkey")).alias("track"), F.when(c("l_quantity") > 25, True).alias("supported"), (c("l_quantity").cast("int") * 4 - 20).alias("days_left"), _pick(["rollup", "security", "hotfix"], c("l_partkey")).alias("hotfix_type"),
        F.array(_pick(_PRODUCTS, c("l_partkey"))).alias("products"), F.array(F.concat(F.lit("26100."), _number(c("l_suppkey")))).alias("builds"), F.array(_pick(["windows", "ios", "macos", "linux"], c("l_linenumber"))).alias("platforms"),
        F.array(_number(2400 + c("l_linenumber")), _number(2410 + c("l_suppkey") % 5)).alias("versions"),
    )


def _sql_others(where: str = "true") -> str:
    top = "case when m.off then {0}_1 else {0}_0 end"
    union = lambda x, name: ", ".join(f"list_sort(list_distinct(list({x}) filter (where off={o}))) as {name}_{i}" for i, o in enumerate(("false", "true")))
    told = "k in ('feature','notice')"
    return f"""with e as (select l_orderkey as event, {_ID} as id, {_sql_pick(_KINDS, 'l_orderkey')} as kind, l_returnflag<>'N' as off, strftime(l_shipdate,'%Y-%m-%d') as upd, l_linenumber=1 as ann, cast(5000000+l_partkey%1000 as varchar) as kb, {_sql_pick(['oob', 'security', 'preview', 'hotpatch'], 'l_partkey')} as rt,
l_discount>=0.1 as expired, {_sql_pick(['ga', 'public_preview', 'in_development'], 'l_suppkey')} as stage, {_sql_pick(['deprecation', 'change', 'feature', 'feature'], 'l_suppkey')} as ck, l_quantity>45 as aa, l_tax>0.05 as lic, cast(2400+l_linenumber as varchar) as version, {_sql_pick(['tp', 'cb', 'cb'], 'l_partkey')} as track,
cast(trunc(l_quantity) as int)*4-20 as days, {_sql_pick(['rollup', 'security', 'hotfix'], 'l_partkey')} as ht, {_sql_pick(_PRODUCTS, 'l_partkey')} as product, '26100.'||l_suppkey as build, {_sql_pick(['windows', 'ios', 'macos', 'linux'], 'l_linenumber')} as platform, list_sort(list_distinct([cast(2400+l_linenumber as varchar), cast(2410+l_suppkey%5 as varchar)])) as versions from lineitem where {where}),
g as (select event, arg_max(struct_pack(off:=off,kind:=kind,ann:=ann,kb:=kb,rt:=rt,stage:=stage,ck:=ck,lic:=lic,version:=version,track:=track,days:=days,ht:=ht,versions:=versions), struct_pack(o:=off::int,a:=upd,i:=id)) as m, {union('product', 'p')}, {union('build', 'b')}, {union('platform', 'f')}, {", ".join(f"coalesce(bool_or({c}) filter (where off={o}), false) as {c}_{i}" for c in ('expired', 'aa') for i, o in enumerate(('false', 'true')))} from e group by 1),
s as (select event, m.kind as k, m.ann and m.kind in ('feature','notice') as note, {top.format('p')} as p, {top.format('b')} as b, {top.format('f')} as f, {top.format('expired')} as x, {top.format('aa')} as a, m from g),
u as (select event, case when note then 'notice' else k end as kind, case when k in ('release','hotfix') then m.kb end as kb, case when k='release' then m.rt end as release_type, case when k='release' then p end as products, case when k='release' then b end as builds, case when k='release' then x end as expired,
case when {told} then case when note then 'notice' else m.stage end end as stage, case when {told} then case when note then 'announcement' else m.ck end end as change_kind, case when {told} then case when note then []::varchar[] else f end end as platforms, case when {told} then not note and a end as admin_action, case when {told} then not note and m.lic end as license,
case when k='version' then m.version end as version, case when k='version' then m.track end as track, case when k='version' then true end as supported, case when k='version' then case when m.days<0 then 'ended' when m.days<=7 then '<=7' when m.days<=30 then '<=30' when m.days<=90 then '<=90' when m.days<=180 then '<=180' else '>180' end end as support_bucket,
case when k='hotfix' then m.versions end as versions, case when k='hotfix' then m.ht end as hotfix_type from s)
select *, case kind when 'release' then case when expired then 'high' when release_type='oob' then 'high' when release_type in ('security','hotpatch') then 'medium' else 'low' end when 'version' then case when track='tp' then 'low' when support_bucket in ('ended','<=7','<=30') then 'high' when support_bucket='<=90' then 'medium' else 'low' end
when 'hotfix' then case hotfix_type when 'security' then 'high' else 'medium' end else case when change_kind='deprecation' or admin_action then 'medium' else 'low' end end as risk from u"""


@R.query(_sql_others())
def a2_release_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as records of releases, features, notices, versions and hotfixes."""
    return fusion.main_states(_records(table(spark, sf_dir, "lineitem")), "event")


def _more(c: str, a: str = "n", b: str = "o") -> str:
    return f"len(list_filter(coalesce({a}.{c},[]), lambda x: not list_contains(coalesce({b}.{c},[]), x)))>0"


_RANK = "coalesce(list_position(['low','medium','high','critical'], {0}.risk),0)"
_UP, _DOWN = f"{_RANK.format('n')}>{_RANK.format('o')}", f"{_RANK.format('n')}<{_RANK.format('o')}"
_EVID = "list_position(['field','ms_official','ms_known_issue'], {0}.evidence)"
_DONE, _EASED = "{0}.status in ('resolved','resolved_external')", "{0}.status in ('mitigated','mitigated_external')"
_SPECIFIC = "list_filter({0}.tags, lambda t: not list_contains(['update_install','performance','apps','security'], t))"
_JACCARD = "len(list_intersect(n.workaround_tokens,o.workaround_tokens))/greatest(len(list_distinct(n.workaround_tokens||o.workaround_tokens)),1)"
_ISSUE_RULES = [
    (f"{_EVID.format('n')}>{_EVID.format('o')}", "ms_confirmed", True), (f"{_DONE.format('n')} and not {_DONE.format('o')}", "fix", True), (f"{_DONE.format('o')} and not {_DONE.format('n')}", "reopened", True),
    (f"{_EASED.format('n')} and not {_EASED.format('o')} and not {_DONE.format('o')}", "workaround", True),
    (f"n.status<>o.status and ({_DONE.format('n')})=({_DONE.format('o')}) and not ({_EASED.format('n')} and not {_EASED.format('o')})", "status", False),
    (_more("products"), "scope_expanded", True), (f"{_more('products', 'o', 'n')} and not {_more('products')}", "correction", True),
    (f"len(list_filter({_SPECIFIC.format('n')}, lambda x: not list_contains({_SPECIFIC.format('o')}, x)))>0 and len(o.tags)>0", "scope_expanded", True),
    (f"{_more('originating_kbs')} and len(o.originating_kbs)>0", "scope_expanded", True), ("n.workaround and not o.workaround or n.kir and not o.kir", "workaround", True),
    (f"n.workaround and o.workaround and not (n.kir and not o.kir) and {_JACCARD}<0.5", "workaround_updated", True), (_more("resolving_kbs"), "fix", True),
    ("len(list_filter(n.partial_fix_kbs, lambda x: not list_contains(o.partial_fix_kbs, x) and (not list_contains(n.resolving_kbs, x) or list_contains(o.resolving_kbs, x))))>0", "partial_fix", True),
    ("n.evidence='field' and n.field_bucket>o.field_bucket and o.field_bucket>0", "spread", True), (f"n.risk<>o.risk", "risk_changed", True),
]
_OTHER_RULES = [
    ("n.kind='release' and n.release_type<>o.release_type", "correction", True), ("n.kind='release' and n.expired and not o.expired", "pulled", True), (f"n.kind='release' and {_more('products')}", "scope", False),
    ("n.kind in ('feature','notice') and n.stage<>o.stage", "stage_changed", True), ("n.kind in ('feature','notice') and n.change_kind='deprecation' and o.change_kind<>'deprecation'", "deprecation", True),
    ("n.kind in ('feature','notice') and n.admin_action and not o.admin_action", "action_required", True), (f"n.kind in ('feature','notice') and {_more('platforms')}", "scope", False),
    ("n.kind='version' and n.support_bucket<>o.support_bucket and (n.support_bucket='ended' or starts_with(n.support_bucket,'<='))", "support_ending", True),
    ("n.kind='hotfix' and n.hotfix_type<>o.hotfix_type", "correction", True), (f"n.kind='hotfix' and {_more('versions')}", "scope", False), (_UP, "risk_changed", True), (_DOWN, "risk_changed", False),
]


def _sql_difference(states, rules: list[tuple[str, str, bool]], which: str) -> str:
    old, new = states(f"l_shipdate < timestamp '1996-01-01' and {which}"), states(f"l_shipdate < timestamp '1997-01-01' and {which}")
    names = ",".join(f"case when {when} then '{name}' end" for when, name, _ in rules)
    return f"select n.event, case when o.event is null then ['new'] else list_sort(list_distinct(list_filter([{names}], lambda x: x is not null))) end as changes, o.event is null or " + " or ".join(f"coalesce({when}, false)" for when, _, m in rules if m) + f" as material from ({new}) n left join ({old}) o on n.event=o.event"


@R.query(_sql_difference(_sql_issues, _ISSUE_RULES, "l_orderkey%2=0") + " union all " + _sql_difference(_sql_others, _OTHER_RULES, "l_orderkey%2=1"))
def w3_state_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of orders at two dates and what has changed between them; even orders are issues, odd ones other events."""
    lines = table(spark, sf_dir, "lineitem")

    def states(until: str) -> tuple[DataFrame, DataFrame]:
        told = lines.where(F.col("l_shipdate") < until)
        return _issues(told.where("l_orderkey % 2 = 0")).withColumn("kind", F.lit("issue")), fusion.main_states(_records(told.where("l_orderkey % 2 = 1")), "event")

    parts = [fusion.difference(old, new, "event") for old, new in zip(states("1996-01-01"), states("1997-01-01"), strict=True)]
    return parts[0].union(parts[1]).withColumn("changes", F.array_sort("changes"))


@R.query("""with recursive h as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events),
v as (select user_id, ts, event_id, event_type, value, rn, 1 as version from h where rn=1 union all select user_id, b.ts, b.e, b.t, b.x, b.rn, version+1 from (select v.user_id, v.version, min(struct_pack(rn:=h.rn, ts:=h.ts, e:=h.event_id, t:=h.event_type, x:=h.value)) as b from v join h on h.user_id=v.user_id and h.rn>v.rn and (h.event_type='error' and v.event_type<>'error' or abs(h.value-v.value)>=25) group by 1,2))
select user_id, ts, event_id, event_type, value, version from v""")
def w4_f5_material_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of users: an error after something else, or a value 25 away from the last version's, makes a version."""
    return folding.emitted(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"], lambda a, b: (b[0] == "error" and a[0] != "error") or abs(b[1] - a[1]) >= 25)


@R.query(f"select event, kind, risk from ({_sql_others()}) union all select event+1000000000, 'issue', risk from ({_sql_issues()})")
def p13_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk of every kind of event."""
    lines = table(spark, sf_dir, "lineitem")
    issues = _issues(lines).select((F.col("event") + 1000000000).alias("event"), F.lit("issue").alias("kind"), "risk")
    return fusion.main_states(_records(lines), "event").select("event", "kind", "risk").union(issues)


_MODULES = ["windows", "configmgr", "intune", "news"]
_EVENTS = ["issue", "version", "hotfix", "release"]


@R.query(f"""with d as (select doc_id, {_sql_pick(_MODULES, 'doc_id')} as m, {_sql_pick(_EVENTS, 'doc_id//4')} as k, source, lang, doc_id%7=0 as f, cast(2400+doc_id%5 as varchar) as v, [cast(2400+doc_id%5 as varchar), cast(2400+doc_id%3 as varchar)] as vs, doc_id%11=0 as novs, case doc_id%3 when 0 then 'rollup' when 1 then 'summary' else 'early_ring' end as ht, case when doc_id%2=0 then 'tp' else 'cb' end as t,
case doc_id%3 when 0 then []::varchar[] when 1 then ['ios'] else ['linux'] end as p, lower(coalesce(text,'')) as x from documents),
w as (select *, case when novs then []::varchar[] else vs end as l from d),
s as (select *, case when source in ('src1','src2','src3') then 2.0 else 0.0 end + case when m='windows' and doc_id%5=0 then 1.5 else 0.0 end + case when m<>'configmgr' then 0.0 when k='version' and v='2402' then 3.0 when k='hotfix' and list_contains(l,'2402') then 2.0 when k='hotfix' and ht in ('summary','early_ring') and coalesce(list_max(l),'')>'2402' then 0.5 when k='version' and t='tp' then 0.5 else 0.0 end as score from w)
select doc_id, case when m='configmgr' and k='issue' and len(l)>0 and not list_contains(l,'2402') then least(score,0.0) + case when f then 3.0 else 0.0 end else score + case when m='intune' and (len(p)=0 or list_contains(p,'ios')) then 1.0 else 0.0 end + case when f then 3.0 else 0.0 end + case when contains(x,'the') then 1.0 else 0.0 end + case when contains(x,'stupid') then -100.0 else 0.0 end end as relevance from s""")
def p14_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as events of four modules and kinds, for one reader."""
    n = F.col("doc_id")
    versions = F.when(n % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(_number(2400 + n % 5), _number(2400 + n % 3)))
    state = {
        "products": F.array("source"), "tags": F.when(n % 5 == 0, F.array(F.lit("rds"))).otherwise(F.array(F.lit("audio"))), "versions": versions, "version": _number(2400 + n % 5), "track": _pick(["tp", "cb"], n),
        "hotfix_type": _pick(["rollup", "summary", "early_ring"], n), "platforms": F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(F.lit("ios"))).otherwise(F.array(F.lit("linux"))),
    }
    reader = fusion.Profile(products=["src1", "src2", "src3"], roles=["rds"], version="2402", tracks=["tp"], platforms=["ios"], keywords=["the"], excluded=["Stupid"])
    score = fusion.relevance(_pick(_MODULES, n), _pick(_EVENTS, F.floor(n / 4)), state, reader, n % 7 == 0, F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("relevance"))

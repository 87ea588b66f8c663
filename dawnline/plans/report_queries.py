"""Change capture, versions, ranking, selection and reports as queries, each with its SQL twin.

events stand for polls, checks, usage and user actions; orders and their lines for events and their versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnline.operators import changes, ranking, reports, selection, tables
from dawnline.plans.tables import Registry, table
from dawnline.workspace import shared_path

R = Registry()
CUT = "2024-01-16"


def _polls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What is known of users' kinds of events by a day, and what comes after it: some users are on one side only, some contents stay as they are."""
    user = F.col("user_id")
    events = table(spark, sf_dir, "events").select(user, "event_type", F.floor(F.col("value") / 50).cast("double").alias("value"), F.when(user % 3 == 0, F.col("props")).alias("props"), "ts", "event_id")
    current = ranking.latest(events.where((F.col("ts") < CUT) & (user % 7 != 0)), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return current, events.where((F.col("ts") >= CUT) & (user % 5 != 0))


_CAPTURE = f"""with ev as (select user_id, event_type, floor(value/50) as value, case when user_id%3=0 then props end as props, ts, event_id from events),
c as (select * from (select *, row_number() over (partition by user_id,event_type order by ts desc,event_id desc) n from ev where ts < '{CUT}' and user_id%7<>0) where n=1),
b as (select * from (select *, row_number() over (partition by user_id,event_type order by ts,event_id) n from ev where ts >= '{CUT}' and user_id%5<>0) where n=1),
j as (select coalesce(c.user_id,b.user_id) as user_id, coalesce(c.event_type,b.event_type) as event_type, c.event_id as ci, b.event_id as bi, c.value as cv, c.props as cp, coalesce(b.value,c.value) as value, coalesce(b.props,c.props) as props from c full outer join b on c.user_id=b.user_id and c.event_type=b.event_type)
select user_id, event_type, case when ci is null then 'inserted' when bi is null then 'absent' when cv is not distinct from value and cp is not distinct from props then 'unchanged' else 'changed' end as change, round(value,6) as value, props from j"""


@R.query(_CAPTURE)
def j1_change_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, batch = _polls(spark, sf_dir)
    out = changes.capture(current, batch, ["user_id", "event_type"], ["value", "props"], [F.col("ts"), F.col("event_id")])
    return out.withColumn("value", F.round("value", 6))


@R.query(f"select event_type, change, date '2024-01-16' as capture_date, count(*) as n from ({_CAPTURE}) where change in ('inserted','changed') group by all")
def io9_snapshots_to_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and changed rows appended to a table by capture date, and read back from there."""
    current, batch = _polls(spark, sf_dir)
    out = changes.capture(current, batch, ["user_id", "event_type"], ["value", "props"], [F.col("ts"), F.col("event_id")])
    path = shared_path(spark, "snapshots")
    tables.append_snapshots(changes.snapshots(out), path, F.lit(CUT).cast("date"))
    return spark.read.parquet(path).groupBy("event_type", "change", "capture_date").agg(F.count("*").alias("n"))


@R.query(f"select user_id, event_type, value, props from ({_CAPTURE})")
def io10_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches upserted one after the other, and the first of them once more, into a table of the current state."""
    current, batch = _polls(spark, sf_dir)
    state = tables.CurrentState(spark, shared_path(spark, "state"), ["user_id", "event_type"], ["value", "props"])
    order = [F.col("ts"), F.col("event_id")]
    for part in (current, batch, batch):
        state.upsert(part, order)
    return state.read().select("user_id", "event_type", F.round("value", 6).alias("value"), "props")


@R.query("select event_id, lead(ts) over w as valid_to, count(*) over (w rows between unbounded preceding and current row) as nth from events window w as (partition by user_id, event_type order by ts, event_id)")
def w9_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.validity(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "valid_to", "nth")


@R.query("with f as (select user_id, min(ts) as first_ok from events where event_type='purchase' group by 1) select event_id, coalesce(ts <= first_ok, true) as first_run from events left join f using (user_id)")
def w8_first_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    runs = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("ok_at"))
    return changes.with_first_run(events, runs, "user_id", "ts", "ok_at").select("event_id", "first_run")


_ACTION = "case event_type when 'view' then 'view' when 'click' then case when value < 30 then 'unread' else 'read' end when 'purchase' then 'follow' when 'signup' then 'unfollow' else case when value < 30 then 'unmute' else 'mute' end end"


def _sql_held(on: str, off: str, name: str) -> str:
    """SQL of whether an action holds since the last one that takes it back, and since when."""
    holds = f"action='{on}' and (r_{name} is null or struct_pack(t:=ts,e:=event_id) > r_{name})"
    return f"coalesce(bool_or({holds}), false) as {name}, min(ts) filter (where {holds}) as {name}_at"


@R.query(f"""with a as (select user_id, ts, event_id, {_ACTION} as action from events),
r as (select *, {", ".join(f"max(case when action='{off}' then struct_pack(t:=ts,e:=event_id) end) over (partition by user_id) as r_{name}" for name, off in (("read", "unread"), ("followed", "unfollow"), ("muted", "unmute")))},
  last_value(case when action in ('follow','unfollow') then action end ignore nulls) over (partition by user_id order by ts,event_id rows between unbounded preceding and 1 preceding) as before from a)
select user_id, max(ts) filter (where action='view') as viewed_at, {_sql_held("read", "unread", "read")}, {_sql_held("follow", "unfollow", "followed")}, {_sql_held("mute", "unmute", "muted")},
cast(sum(case when action='follow' then 3 when action='unfollow' and before='follow' then -3 else 0 end) as bigint) as relevance_delta from r group by user_id""")
def a13_user_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, back = F.col("event_type"), F.col("value") < 30
    action = F.when(kind == "view", "view").when(kind == "click", F.when(back, "unread").otherwise("read")).when(kind == "purchase", "follow").when(kind == "signup", "unfollow").otherwise(F.when(back, "unmute").otherwise("mute"))
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", action.alias("action"))
    return changes.user_states(log, ["user_id"], "action", "ts", "event_id")


_SOURCES = "select user_id as source, max(ts) filter (where event_type<>'error') as last_ok, arg_max(event_type, struct_pack(t:=ts,e:=event_id)) as last_status, arg_max(event_id, struct_pack(t:=ts,e:=event_id)) filter (where event_type='error') as last_error, count(*) as checks, count(*) filter (where event_type='error') as errors from events group by 1"


def _health(events: DataFrame) -> DataFrame:
    return reports.source_health(events, "user_id", "event_type", "ts", "event_id")


@R.query(_SOURCES)
def a5_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(table(spark, sf_dir, "events"))


@R.query(
    f"""with h as ({_SOURCES}), j as (select c_custkey as source, h.* exclude (source) from customer left join h on source = c_custkey),
n as (select count(*) as enabled, count(*) filter (where last_status<>'error' and last_ok >= timestamp '2024-01-30 00:00:00') as ok, count(*) filter (where last_status='error') as failing, count(*) filter (where checks is null) as never from j),
l as (select source, case when checks is null then 'never' else 'failing' end as state, last_status, last_ok from j where checks is null or last_status='error')
select * from n left join l on true"""
)
def a6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources are well, failing or never checked, and all that are failing or never checked; every customer is an enabled source."""
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"))
    return reports.coverage(sources, _health(table(spark, sf_dir, "events")), F.lit("2024-01-30").cast("timestamp"))


@R.query(f"with h as ({_SOURCES}), e as (select c_custkey as source from customer where c_custkey%2=0) select e.source, case when h.source is null then 'never' else 'failing' end as state, last_ok, last_error from e left join h using (source) where h.source is null or last_status='error'")
def a6_unhealthy_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources that are failing or were never checked."""
    sources = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("source"))
    return reports.unhealthy(sources, _health(table(spark, sf_dir, "events")))


@R.query("select event_type as status, count(*) as n, count(*) filter (where value > 50) as changed, round(sum(value),4) as total from events group by 1")
def a7_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_report(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50, "value")


@R.query("select cast(ts as date) as day, event_type as kind, count(*) as calls, round(sum(value),4) as units, round(sum(value)*0.003,2) as cost, count(*) filter (where event_type='error') as errors, round(greatest(100 - sum(value)*0.003, 0),2) as budget_left from events group by 1,2")
def a8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.usage(table(spark, sf_dir, "events"), F.to_date("ts"), "event_type", "value", F.col("event_type") == "error", 0.003, 100)


_PART = "case when l_linestatus='O' then 'pending' when l_returnflag='R' then 'uncertain' when l_returnflag='N' then 'sent' when l_linenumber%2=0 then 'sent' else 'failed' end"
_ROLLUP = "case when bool_and(p='sent') then 'sent' when bool_or(p='pending') then 'pending' when bool_or(p='uncertain') then 'uncertain' when bool_or(p='sent') then 'partial' else 'failed' end"


@R.query(f"select l_orderkey as delivery, {_ROLLUP} as status, count(*) as parts, count(*) filter (where p='sent') as done from (select l_orderkey, {_PART} as p from lineitem) group by 1")
def a9_delivery_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, flag = F.col("l_linestatus"), F.col("l_returnflag")
    part = F.when(line == "O", "pending").when(flag == "R", "uncertain").when((flag == "N") | (F.col("l_linenumber") % 2 == 0), "sent").otherwise("failed")
    return reports.delivery_status(table(spark, sf_dir, "lineitem").withColumn("part", part), "l_orderkey", F.col("part"))


@R.query("with o as (select o_orderkey, o_orderpriority, o_totalprice from orders where o_orderstatus='O' and o_orderpriority in ('1-URGENT','2-HIGH')), t as (select o_orderkey from o order by o_orderpriority, o_totalprice desc, o_orderkey limit 5) select (select count(*) from o) as open_count, (select list(o_orderkey order by o_orderkey) from t) as top")
def a10_open_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    risky = (F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return reports.open_risks(table(spark, sf_dir, "orders"), risky, [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")], "o_orderkey")


@R.query("select l_orderkey, count(distinct l_suppkey) as sources, list_sort(list_distinct(list(l_suppkey))) as source_list from lineitem group by 1")
def a11_distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sources_of(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@R.query("select split_part(coalesce(text,''), chr(10), 1) as title, count(*) as n from documents group by 1 having count(*) > 1")
def a11_repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return reports.repeated(table(spark, sf_dir, "documents"), title, "title")


@R.query("select l_orderkey, count(*) filter (where l_returnflag='R') as alert_items, count(*) as snapshots from lineitem group by 1")
def a12_items_per_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts_of(table(spark, sf_dir, "lineitem"), "l_orderkey", alert_items=F.col("l_returnflag") == "R").withColumnRenamed("rows", "snapshots")


@R.query("with n as (select source, split_part(coalesce(text,''), chr(10), 1) as title, doc_id, row_number() over (partition by source order by doc_id) as i from documents) select source, count(*) as items, count(*) filter (where title='') as warnings, list(substr(title,1,40) order by doc_id) filter (where i<=3) as samples from n group by 1")
def a14_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"))
    return reports.validation(docs, "source", "doc_id", "title")


_VERSIONS = "select l_orderkey, l_linenumber, row_number() over w as version, lag(l_linestatus) over w as prev_l_linestatus, lag(l_quantity) over w as prev_l_quantity from lineitem window w as (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


@R.query(_VERSIONS)
def w2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ranking.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], ["l_linestatus", "l_quantity"])
    return lines.select("l_orderkey", "l_linenumber", "version", "prev_l_linestatus", "prev_l_quantity")


_LATEST = "select * from (select l_orderkey, l_linenumber, l_shipdate, l_linestatus, l_partkey, l_suppkey, l_extendedprice, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc) as n from lineitem) where n=1"


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_shipdate"), F.desc("l_linenumber")])


@R.query(f"select l_orderkey, l_linenumber, l_shipdate from ({_LATEST})")
def w1_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _newest(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_shipdate")


_CANDIDATES = f"select v.*, o.o_orderpriority, o.o_totalprice, o.o_orderstatus, c.c_mktsegment, c.c_nationkey, c.c_acctbal from ({_LATEST}) v join orders o on o.o_orderkey=v.l_orderkey left join customer c on c.c_custkey=o.o_custkey where v.l_shipdate >= timestamp '1995-01-01'"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = _newest(spark, sf_dir).where(F.col("l_shipdate") >= "1995-01-01")
    return rows.join(orders, rows.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey, "left")


@R.query(f"select l_orderkey, l_linenumber, o_orderpriority, c_mktsegment from ({_CANDIDATES})")
def j11_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest versions since a date, with their event and the user's state."""
    return _candidates(spark, sf_dir).select("l_orderkey", "l_linenumber", "o_orderpriority", "c_mktsegment")


_SECTION = "case when o_orderpriority in ('1-URGENT') and o_totalprice > 200000 then 'critical' else lower(c_mktsegment) end"
_CAPS = {"critical": 6, "automobile": 3, "building": 3, "furniture": 3, "household": 3, "machinery": 3}


@R.query(
    f"""with c as (select l_orderkey, {_SECTION} as section, o_orderpriority, o_totalprice from ({_CANDIDATES})),
r as (select *, row_number() over (partition by section order by o_orderpriority, o_totalprice desc, l_orderkey) as section_rank, list_position([{",".join(f"'{s}'" for s in _CAPS)}], section) as place from c),
k as (select *, row_number() over (order by place, section_rank) as position from r where section_rank <= case section when 'critical' then 6 else 3 end)
select l_orderkey, section, section_rank, position, (select count(*) from c where c.section=k.section) - count(*) over (partition by section) as overflow from k where position <= 16 or section='critical'"""
)
def w5_w6_capped_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 200000), "critical").otherwise(F.lower("c_mktsegment"))
    rows = _candidates(spark, sf_dir).withColumn("section", section)
    order = [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("l_orderkey")]
    return ranking.capped_sections(rows, "section", order, _CAPS, 3, "critical", 16).select("l_orderkey", "section", "section_rank", "position", "overflow")


@R.query(f"select l_orderkey from ({_CANDIDATES}) where l_orderkey not in (select l_orderkey from lineitem where l_returnflag='R')")
def j12_not_yet_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return ranking.not_in_history(_candidates(spark, sf_dir).select("l_orderkey"), history, "l_orderkey")


@R.query(f"select l_orderkey from ({_CANDIDATES}) where l_orderkey in (select l_orderkey from lineitem where l_returnflag='R')")
def j12_already_alerted(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return ranking.in_history(_candidates(spark, sf_dir).select("l_orderkey"), history, "l_orderkey")


_RISK = "case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium' when '5-LOW' then 'low' end"
_EVIDENCE = "case o_orderstatus when 'F' then 'ms_known_issue' when 'P' then 'ms_official' else 'field' end"


def _risk():
    p = F.col("o_orderpriority")
    return F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").when(p == "5-LOW", "low")


def _evidence():
    s = F.col("o_orderstatus")
    return F.when(s == "F", "ms_known_issue").when(s == "P", "ms_official").otherwise("field")


@R.query(f"with r as (select o_orderkey, {_RISK} as risk, {_EVIDENCE} as evidence, o_custkey%4 as sources from orders) select o_orderkey, coalesce(risk in ('high','critical'), false) as risky, evidence in ('ms_official','ms_known_issue') as confirmed, coalesce(risk in ('high','critical'),false) and (evidence<>'field' or (risk='critical' and sources >= 2)) as alert from r")
def p9_alert_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    risky, confirmed = ranking.risk_at_least(_risk(), "high"), ranking.evidence_at_least(_evidence(), "ms_official")
    unconfirmed = F.coalesce((_risk() == "critical") & (F.col("o_custkey") % 4 >= 2), F.lit(False))
    return table(spark, sf_dir, "orders").select("o_orderkey", risky.alias("risky"), confirmed.alias("confirmed"), (risky & (confirmed | unconfirmed)).alias("alert"))


@R.query("select l_orderkey, l_linenumber, (l_tax < 0.04 or (cast(l_tax*100 as int) - 3 < l_linenumber and l_returnflag='R')) and (l_discount < 0.05 or cast(l_discount*100 as int) - 4 < l_linenumber) as allowed from lineitem")
def p8_resurface(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.col("l_linenumber")
    muted = F.when(F.col("l_tax") >= 0.04, F.round(F.col("l_tax") * 100).cast("int") - 3)
    read = F.when(F.col("l_discount") >= 0.05, F.round(F.col("l_discount") * 100).cast("int") - 4)
    risk = F.when(F.col("l_returnflag") == "R", "critical").otherwise("low")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ranking.resurface(version, read, muted, risk, "bulletin", "notify", "critical_only").alias("allowed"))


@R.query("select o_orderkey from orders where o_orderstatus='O' and o_orderpriority in ('1-URGENT','2-HIGH') order by o_orderpriority, o_totalprice desc, o_orderkey limit 8")
def k2_baseline_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderpriority in ('1-URGENT','2-HIGH')").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").select("o_orderkey").limit(8)


_ARCHIVE = "select o_orderkey, o_totalprice, o_orderdate from orders where o_orderpriority ilike '%u%' and o_orderstatus <> 'F'"


@R.query(f"select o_orderkey, (select count(*) from ({_ARCHIVE})) as total, cast(ceil((select count(*) from ({_ARCHIVE}))/25.0) as bigint) as pages from ({_ARCHIVE}) order by o_orderdate desc, o_orderkey limit 25 offset 25")
def p10_k3_archive_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search over orders."""
    found = table(spark, sf_dir, "orders").where(F.ilike("o_orderpriority", F.lit("%u%")) & (F.col("o_orderstatus") != "F"))
    return ranking.page(found, [F.desc("o_orderdate"), F.col("o_orderkey")], 2).select("o_orderkey", "total", "pages")


@R.query("with m as (select l_partkey, max(l_shipdate) as newest from lineitem where l_returnflag='R' and (l_suppkey%3=0 or l_suppkey%5 in (1,2)) group by 1) select l_partkey, newest from m order by newest desc, l_partkey limit 15")
def k4_recent_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest parts of returned lines that name no supplier group or one of the reader's."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    products = F.when(F.col("l_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("l_suppkey") % 5).cast("string")))
    return reports.recent_targets(lines, "l_partkey", "l_shipdate", 15, products, ["1", "2"])


_TOLD = f"select o_orderkey, {_RISK} as risk, o_totalprice > 20000 as relevant, o_orderdate, o_custkey%9=0 as followed, o_custkey%8=0 as muted, o_orderkey%2=0 as issue, o_orderstatus from orders"
_NEWEST = "case risk when 'critical' then 0 else 1 end, o_orderdate desc, o_orderkey limit 50"


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events."""
    who, day = F.col("o_custkey"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event"), _risk().alias("risk"), F.when(F.col("o_totalprice") > 20000, 1.0).otherwise(0.0).alias("relevance"), day.alias("changed_at"), day.alias("first_seen"), (who % 9 == 0).alias("followed"),
        F.when(who % 8 == 0, day).alias("muted_at"), F.when(F.col("o_orderkey") % 2 == 0, "issue").otherwise("release").alias("kind"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("confirmed").alias("status"),
    )


@R.query(f"with t as ({_TOLD}) select o_orderkey, risk, coalesce(relevant, false) as relevant, coalesce(o_orderdate >= timestamp '1998-05-01 00:00:00' - interval 21 day, false) as recent from t where risk in ('high','critical') order by case risk when 'critical' then 0 else 1 end, o_orderdate desc, o_orderkey")
def k5_critical_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is risky, and whether it concerns the reader and has changed within 21 days."""
    since = F.lit("1998-05-01").cast("timestamp") - F.expr("interval 21 days")
    return selection.critical_view(_told(spark, sf_dir), since).select(F.col("event").alias("o_orderkey"), "risk", "relevant", "recent")


@R.query(f"with t as ({_TOLD}) select * from (select 'followed' as list, o_orderkey from t where followed order by o_orderdate desc, o_orderkey limit 50) union all select * from (select 'open' as list, o_orderkey from t where issue and o_orderstatus<>'F' and risk in ('high','critical') and relevant and not followed and not muted order by {_NEWEST})")
def k5_tracking_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader follows, and open risks that they don't."""
    rows = _told(spark, sf_dir)
    lists = {"followed": selection.followed_view(rows), "open": selection.open_risk_view(rows)}
    return lists["followed"].select(F.lit("followed").alias("list"), F.col("event").alias("o_orderkey")).union(lists["open"].select(F.lit("open"), "event"))


@R.query("with s as (select event_id, cast(ts as date) as day, value*0.01 as cost, row_number() over w as n, coalesce(sum(value*0.01) over (w rows between unbounded preceding and 1 preceding),0) as spent from events window w as (partition by cast(ts as date) order by event_type, event_id)) select event_id, (n-1)//25 as batch from s where spent < 20 and n <= 60")
def w7_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), (F.col("value") * 0.01).alias("cost"))
    out = ranking.within_budget(rows, [F.col("event_type"), F.col("event_id")], "cost", 20, 60, 25, part="day")
    return out.select("event_id", F.col("batch").cast("long").alias("batch"))


_NEXT = "case when l_linenumber < 6 then l_shipdate + to_seconds(coalesce(case when l_returnflag='R' then 90 end, [60,300,900,3600,10800][least(l_linenumber,5)])) end"


@R.query(f"select l_orderkey, l_linenumber, case when l_linestatus='F' and l_returnflag='A' then null else {_NEXT} end as next_at, case when l_linestatus='F' and l_returnflag='A' then 'sent' when l_linenumber < 6 then 'retry' else 'failed' end as state, coalesce(case when l_linestatus='F' and l_returnflag='A' then null else {_NEXT} end <= timestamp '1996-01-01 00:00:00', false) as due from lineitem")
def p18_next_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as delivery attempts: what their results make of them, when they are tried again, and which are due."""
    asked, sent = F.when(F.col("l_returnflag") == "R", 90), (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")
    tried = table(spark, sf_dir, "lineitem").withColumns({"a": ranking.after_attempt(sent, F.col("l_linenumber"), F.col("l_shipdate"), asked)})
    due = F.coalesce(F.col("a.next_at") <= F.lit("1996-01-01").cast("timestamp"), F.lit(False))
    return tried.select("l_orderkey", "l_linenumber", "a.next_at", "a.state", due.alias("due"))


@R.query("select event_type, cast(floor(epoch(ts)/10800) as bigint) as slot, count(*) as n from events group by 1,2")
def st1_tumbling_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.floor(F.unix_timestamp("ts") / 10800).cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type", slot.alias("slot")).agg(F.count("*").alias("n"))


@R.query("with l as (select user_id, arg_max(event_type, struct_pack(t:=ts,e:=event_id)) as status, max(ts) as seen, count(*) filter (where event_type='error') as tries from events group by 1) select user_id, status, case when status='error' and tries<=3 and seen < timestamp '2024-01-30 23:50:00' then 'retry' when status='view' and seen < timestamp '2024-01-30 23:30:00' then 'stuck' when status='click' and seen < timestamp '2024-01-30 23:30:00' then 'uncertain' else 'fine' end as verdict from l")
def st8_stuck_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"), F.count_if(F.col("event_type") == "error").alias("tries"))
    now = F.lit("2024-01-31").cast("timestamp")
    verdict = ranking.work_verdict(F.col("status"), F.col("at"), F.col("tries"), now, running="view", failed="error", sending="click")
    return last.select("user_id", "status", verdict.alias("verdict"))

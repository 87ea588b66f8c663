"""Labels, selection, composition and upkeep as queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnline.functions import dates, fixed, labels, text
from dawnline.operators import ordered, reports, selection, tables
from dawnline.plans.tables import Registry, table
from dawnline.workspace import shared_path

R = Registry()


def _rules(value: str, rules, otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({value}), '{p}') then '{name}'" for p, name in rules) + f" else '{otherwise}' end"


_RAW = "case l_linenumber%7 when 0 then 'Resolved External' when 1 then 'Resolved KB1' when 2 then 'Mitigated' when 3 then 'Confirmed' when 4 then 'Reported' when 5 then 'Mitigated External' else l_returnflag end"


def _raw() -> F.Column:
    n = F.col("l_linenumber") % 7
    return F.when(n == 0, "Resolved External").when(n == 1, "Resolved KB1").when(n == 2, "Mitigated").when(n == 3, "Confirmed").when(n == 4, "Reported").when(n == 5, "Mitigated External").otherwise(F.col("l_returnflag"))


@R.query(f"select l_orderkey, l_linenumber, l_partkey, {_rules(_RAW, fixed.STATUS_RULES, 'unknown')} as status from lineitem")
def t25_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", labels.status(_raw()).alias("status"))


_SAID = ["New feature (preview) for iOS/iPadOS. Rolling out over the coming weeks. ", "Plan for change: admins must act. ", "It will be removed soon. It needs a premium licence. ", "Summary of changes for macOS. ", "Security rollup for Android and Linux. ", "Early update ring. How can you prepare? Move **devices** first. ", ""]
_SAID_SQL = "([" + ",".join(f"'{x}'" for x in _SAID) + "][doc_id%7+1] || coalesce(text,''))"
_PAGES = "['whats_new','in_development','notices'][doc_id%3+1]"
_PLATFORMS = "list_filter([" + ",".join(f"case when regexp_matches(lower({_SAID_SQL}), '{p}') then '{n}' end" for n, p in fixed.PLATFORMS.items()) + "], lambda x: x is not null)"
_CHANGE_SQL = _rules(f"substr({_SAID_SQL},1,800)", fixed.CHANGE_RULES, "feature")
_NOTE_SQL = "substr(trim(regexp_replace(regexp_extract({s}, '{p}', 0), '\\s+', ' ', 'g')),1,400)"


@R.query(
    f"select doc_id, case {_PAGES} when 'in_development' then 'in_development' when 'notices' then 'notice' else {_rules(f'substr({_SAID_SQL},1,600)', fixed.STAGE_RULES, 'ga')} end as stage, case when {_PAGES}='notices' and {_CHANGE_SQL}='feature' then 'change' else {_CHANGE_SQL} end as change, {_rules(_SAID_SQL, fixed.HOTFIX_RULES, 'hotfix')} as hotfix, {_PLATFORMS} as platforms, "
    f"{_NOTE_SQL.format(s=_SAID_SQL, p=fixed.LICENCE_NOTE)} as licence, {_NOTE_SQL.format(s=_SAID_SQL, p=fixed.ROLLOUT_NOTE)} as rollout, case when doc_id%7=5 then length(trim(substr(trim(regexp_replace(' Move devices first. '||coalesce(text,''), '\\s+', ' ', 'g')),1,1200))) > 0 else false end as action from documents"
)
def t24_t27_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents after a phrase that their number tells, on one of three pages."""
    n, none = F.col("doc_id"), F.lit(None).cast("string")
    said = F.concat(F.element_at(F.array(*map(F.lit, _SAID)), (n % 7 + 1).cast("int")), F.coalesce("text", F.lit("")))
    page = F.element_at(F.array(F.lit("whats_new"), F.lit("in_development"), F.lit("notices")), (n % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("said"), page.alias("page"))
    body, page = F.col("said"), F.col("page")
    return rows.select(
        "doc_id", labels.stage(none, body, page).alias("stage"), labels.change_kind(none, body, page).alias("change"), labels.hotfix_type(body).alias("hotfix"), labels.platforms(body).alias("platforms"),
        labels.licence_note(body).alias("licence"), labels.rollout_note(body).alias("rollout"), (labels.admin_action(body) != "").alias("action"),
    )


_WARNING = "Important: This section tells about modifying the registry. Back it up first, see how to back up and restore the registry in Windows."


@R.query("select doc_id, length(trim(case when doc_id%2=0 then split_part(coalesce(text,''),chr(10),1)||'  '||coalesce(text,'') else coalesce(text,'') end)) as chars from documents")
def t15_without_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second text has the standard warning between its first line and the whole; trim() takes spaces only, as in SQL."""
    body = F.coalesce("text", F.lit(""))
    warned = F.when(F.col("doc_id") % 2 == 0, F.concat(F.substring_index(body, "\n", 1), F.lit(f" {_WARNING} "), body)).otherwise(body)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.without_registry_warning(warned)).cast("long").alias("chars"))


_TAGS = ["auth", "rds", "dc", "vpn", "network", "performance", "apps"]


def _tag_set(seed: str) -> F.Column:
    return F.array_compact(F.array(*(F.when(F.col(seed) % (i + 2) == 0, F.lit(t)) for i, t in enumerate(_TAGS))))


_A, _B = ("list_filter([" + ",".join(f"case when {seed}%{i + 2}=0 then '{t}' end" for i, t in enumerate(_TAGS)) + "], lambda x: x is not null)" for seed in ("l_partkey", "l_suppkey"))
_WEAK = "[" + ",".join(f"'{t}'" for t in fixed.WEAK_TAGS) + "]"
_BROAD = "[" + ",".join(f"'{t}'" for t in fixed.BROAD_TAGS) + "]"


@R.query(
    f"with t as (select l_orderkey, l_linenumber, l_partkey, list_filter({_A}, lambda x: not list_contains({_WEAK},x)) as a, list_filter({_B}, lambda x: not list_contains({_WEAK},x)) as b from lineitem), u as (select *, list_intersect(a,b) as c, list_filter(a, lambda x: not list_contains({_BROAD},x)) as da, list_filter(b, lambda x: not list_contains({_BROAD},x)) as db from t) select l_orderkey, l_linenumber, l_partkey, case when len(a)=0 or len(b)=0 then true when len(c)=0 then false else not (len(list_filter(c, lambda x: not list_contains({_BROAD},x)))=0 and len(da)>0 and len(db)>0 and len(list_intersect(da,db))=0) end as compatible from u"
)
def t18_t19_tag_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.tags_compatible(_tag_set("l_partkey"), _tag_set("l_suppkey")).alias("compatible"))


_MODULE = "case c_mktsegment when 'BUILDING' then 'windows' when 'AUTOMOBILE' then 'intune' when 'MACHINERY' then 'news' when 'HOUSEHOLD' then 'community' else 'configmgr' end"


def _module() -> F.Column:
    s = F.col("c_mktsegment")
    return F.when(s == "BUILDING", "windows").when(s == "AUTOMOBILE", "intune").when(s == "MACHINERY", "news").when(s == "HOUSEHOLD", "community").otherwise("configmgr")


@R.query(f"with s as (select c_custkey, {_MODULE} as module, case when c_nationkey%3=0 then c_acctbal > 0 else c_nationkey%5 in (1,2) end as enabled, c_acctbal > 5000 as critical from customer) select c_custkey from s where enabled and module in ('windows','community') and critical")
def p1_p2_chosen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources: those of a nation group that the reader has chosen are on."""
    nation = F.col("c_nationkey")
    products = F.when(nation % 3 == 0, F.array().cast("array<string>")).otherwise(F.array((nation % 5).cast("string")))
    sources = table(spark, sf_dir, "customer").select("c_custkey", _module().alias("module"), (F.col("c_acctbal") > 0).alias("enabled"), (F.col("c_acctbal") > 5000).alias("critical"), products.alias("product_ids"))
    return selection.chosen_sources(selection.with_products_on(sources, ["1", "2"]), ["windows", "community"], ["windows", "intune"], critical_only=True).select("c_custkey")


@R.query("select c_custkey, c_nationkey from customer where c_nationkey%7<>0")
def p11_real_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without those of the demonstration; an unknown mark is no demonstration."""
    nation = F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").withColumn("is_demo", F.when(nation % 7 == 0, True).when(nation % 7 == 1, False))
    real, demo = selection.of_partition(rows, False), selection.of_partition(rows, True)
    return real.join(demo.select("c_custkey"), "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


_ITEM = f"select c_custkey, {_MODULE} as module, c_acctbal/1000 - 3 as score, c_nationkey%5=0 as followed, case when c_nationkey%2=0 then 'issue' else 'release' end as kind, case when c_nationkey%3=0 then 'field' else 'ms_official' end as evidence, case when c_nationkey%4=0 then 'resolved' when c_nationkey%4<3 then 'confirmed' end as status, case when c_custkey%3=0 then 'critical' else 'low' end as risk from customer"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", _module().alias("module"), (F.col("c_acctbal") / 1000 - 3).alias("score"), (nation % 5 == 0).alias("followed"), F.when(nation % 2 == 0, "issue").otherwise("release").alias("kind"),
        F.when(nation % 3 == 0, "field").otherwise("ms_official").alias("evidence"), F.when(nation % 4 == 0, "resolved").when(nation % 4 < 3, "confirmed").alias("status"),
        F.when(F.col("c_custkey") % 3 == 0, "critical").otherwise("low").alias("risk"),
    )


@R.query(f"with i as ({_ITEM}) select c_custkey, case when score < -10 then false when module in ('news','content') or followed then true when module='windows' then score>0 else score>0 or module in ('intune','configmgr') end as relevant, case when module='news' then 'news_general' when module='content' then 'content' when kind='issue' and evidence='field' then 'field' when module in ('windows','intune','configmgr') then module else 'windows' end as section, module in ('windows','news','configmgr') and not (kind='issue' and evidence='field') as module_on, coalesce(followed and kind='issue' and status not in ('resolved','resolved_external'), false) or (risk in ('high','critical') and score>=1.5 and not (kind='issue' and evidence='field')) as critical from i")
def p5_p7_relevance_and_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _items(spark, sf_dir).select(
        "c_custkey", selection.relevant(c("module"), c("score"), c("followed"), True).alias("relevant"), selection.section(c("module"), c("kind"), c("evidence"), F.lit(None).cast("string")).alias("section"),
        selection.module_on(c("module"), c("kind"), c("evidence"), ["windows", "news", "configmgr"]).alias("module_on"),
        selection.critical_for_reader(c("followed"), c("kind"), c("status"), c("risk"), c("score"), c("evidence")).alias("critical"),
    )


@R.query("with o as (select l_orderkey, case l_suppkey%5 when 0 then 'javascript:' when 1 then 'http://p' else 'https://p' end||l_suppkey as url, min(case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end * 1000000000 + l_partkey) as k from lineitem where l_suppkey%5<>0 group by 1,2), r as (select *, row_number() over (partition by l_orderkey order by k, url) as n from o) select l_orderkey, list(url order by n) as links from r where n<=3 group by 1")
def p12_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    trust = F.when(flag == "R", "official").when(flag == "A", "press").otherwise("community")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", trust.alias("trust"), F.concat(F.when(F.col("l_suppkey") % 5 == 0, "javascript:").when(F.col("l_suppkey") % 5 == 1, "http://p").otherwise("https://p"), F.col("l_suppkey").cast("string")).alias("url"))
    return selection.references(rows, "l_orderkey", "trust", "l_partkey", "url", top=3)


@R.query("select o_orderkey, o_orderpriority||' · '||o_orderstatus as badge, round(coalesce(c_acctbal,0),2) as balance, o_orderdate < timestamp '1996-01-01' as stale from orders left join customer on c_custkey=o_custkey")
def p15_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    return rows.select("o_orderkey", F.concat_ws(" · ", "o_orderpriority", "o_orderstatus").alias("badge"), F.round(F.coalesce("c_acctbal", F.lit(0.0)), 2).alias("balance"), (F.col("o_orderdate") < "1996-01-01").alias("stale"))


@R.query("select l_orderkey, arg_max(l_partkey, struct_pack(d:=l_shipdate,n:=l_linenumber,p:=l_partkey)) as newest, any_value(o_orderpriority) as trust from lineitem join orders on o_orderkey=l_orderkey group by 1")
def j9_newest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = reports.newest_of(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"], "l_partkey", "newest")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("trust"))
    return newest.join(orders, "l_orderkey")


@R.query("select o_orderkey from orders where o_orderdate >= timestamp '1996-06-01' or o_orderkey in (select l_orderkey from lineitem where l_returnflag='R')")
def j15_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return selection.retained(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", F.lit("1996-06-01").cast("timestamp"), used, "o_orderkey").select("o_orderkey")


@R.query("with d as (select l_orderkey, min(l_partkey) as detail from lineitem where l_returnflag='A' group by 1), r as (select o_orderkey, detail, detail is null as missing, row_number() over (partition by detail is null order by o_orderkey desc) as n from orders left join d on l_orderkey=o_orderkey) select o_orderkey, detail, missing, missing and n<=10 as queued from r")
def j19_carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("detail"))
    return selection.carried_forward(table(spark, sf_dir, "orders").select("o_orderkey"), known, "o_orderkey", "detail", F.desc("o_orderkey"), 10)


@R.query("with b as (select o_orderkey, 0 as part from orders where o_orderstatus='P' order by o_totalprice desc, o_orderkey limit 6), s as (select o_orderkey, 1 as part from orders where o_orderpriority='1-URGENT' order by o_totalprice desc, o_orderkey limit 8), u as (select * from b where o_orderkey not in (select o_orderkey from s) union all select * from s) select o_orderkey, row_number() over (order by part, o_orderkey) - 1 as position from u")
def k7_s1_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    top = lambda where, n, part: orders.where(where).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(n).select("o_orderkey", F.lit(part).alias("part"))
    return selection.composed(top("o_orderstatus = 'P'", 6, 0), top("o_orderpriority = '1-URGENT'", 8, 1), "o_orderkey", [F.col("part"), F.col("o_orderkey")]).select("o_orderkey", "position")


@R.query("with n as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events), x as (select distinct user_id, event_type from events where value > 99) select event_id, ((hour(ts + interval 3 hour)*60+minute(ts + interval 3 hour)) >= 1350 or (hour(ts + interval 3 hour)*60+minute(ts + interval 3 hour)) < 450) and event_type<>'error' as deferred from n where n=1 and value > 50 and not exists (select 1 from x where x.user_id=n.user_id and x.event_type=n.event_type)")
def k6_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type over a threshold, but of those that have been alerted before."""
    quiet = dates.in_quiet_hours(F.col("ts"), "22:30", "07:30")
    rows = table(spark, sf_dir, "events").withColumn("event", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    before = rows.where("value > 99").select("event").distinct()
    return selection.alerts(rows, "event", [F.desc("ts"), F.desc("event_id")], F.col("value") > 50, quiet, F.col("event_type") == "error", before).select("event_id", "deferred")


@R.query("with r as (select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc) as n from lineitem) select l_orderkey, l_linenumber, l_partkey, n from r where n<=2")
def k8_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_partkey")]
    return reports.timeline(table(spark, sf_dir, "lineitem"), "l_orderkey", order, 2).select("l_orderkey", "l_linenumber", "l_partkey", "n")


@R.query("with p as (select case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end as rank, o_orderstatus='F' as official, o_orderkey from orders) select o_orderkey, row_number() over (partition by rank order by official desc, o_orderkey) as place from p")
def k1_processing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within each priority, which is what a replay needs; ranges of the order count their own rows."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", rank.alias("rank"), (F.col("o_orderstatus") != "F").alias("later"))
    return ordered.placed(rows, ["rank"], [F.col("later"), F.col("o_orderkey")]).select("o_orderkey", "place")


@R.query("select strftime(o_orderdate, '%Y-%m') as slot, count(*) as n from orders where o_orderstatus='P' group by 1")
def io11_idempotent_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice by slot; the second time nothing is added, though the rows of a slot have doubled."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("slot"))
    root = shared_path(spark, "bulletin")
    tables.write_slots(rows, root, "slot")
    tables.write_slots(rows.union(rows), root, "slot")
    return spark.read.parquet(f"{root}/rows").groupBy(F.col("slot").cast("string").alias("slot")).agg(F.count("*").alias("n"))


@R.query("with a as (select c_nationkey, list_sort(list_distinct(list(c_mktsegment))) as x from customer group by 1), b as (select n_nationkey, ['BUILDING','MACHINERY'] as y from nation) select n_nationkey, list_sort(list_filter(x, lambda v: not list_contains(y,v))) as added, len(list_intersect(x,y))>0 as overlap from b join a on c_nationkey=n_nationkey")
def s2_s3_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_set("c_mktsegment").alias("x"))
    y = F.array(F.lit("BUILDING"), F.lit("MACHINERY"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey").join(sets, "n_nationkey")
    return rows.select("n_nationkey", F.array_sort(F.array_except("x", y)).alias("added"), F.arrays_overlap("x", y).alias("overlap"))



"""Sources, extraction, daily data, generated texts and streams as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dawnline.functions import text, urls
from dawnline.operators import daily, generated, ranking
from dawnline.plans import state_queries
from dawnline.plans.tables import Registry, table
from dawnline.plans.text_queries import SQL_ISSUE, SQL_PADDED, SQL_SCOPE, SQL_TITLE, first_line, sql_fold
from dawnline.sources import feeds, html, markdown
from dawnline.streaming import jobs
from dawnline.workspace import stored

R = Registry()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.parsed(table(spark, sf_dir, "pages"))


@R.query()
def x1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and block text of every page."""
    return _pages(spark, sf_dir).select("page_id", "title", F.length("text").alias("chars"), F.size(html.sections(F.col("text"))).alias("blocks"), "updated")


_DATED = [
    '<meta name="updated_at" content="2024-01-01"><meta name="ms.date" content="2024-02-{d}">', '<meta property="article:modified_time" content="2024-03-{d}"><time>2020-01-01</time>', '<p>Of <time datetime="2024-04-{d}">April</time></p>',
    "<time> 2024-05-{d} </time><time>2019-01-01</time>", '<time>2018-01-01</time><time data-article-date datetime="2024-06-{d}">x</time>', '<meta name="date" content="2017-01-01"><p>none</p>',
]


@R.query("select doc_id, case when doc_id%6<5 then '2024-0'||(2+doc_id%6)||'-'||(10+doc_id%19) end as updated from documents")
def x13_page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages that tell their date by a meta element, a time element or its text, or don't."""
    day = (F.lit(10) + F.col("doc_id") % 19).cast("string")
    form = F.element_at(F.array(*map(F.lit, _DATED)), (F.col("doc_id") % 6 + 1).cast("int"))
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit("https://a.org").alias("url"), F.replace(form, F.lit("{d}"), day).alias("html"))
    return html.parsed(pages, "doc_id").select("doc_id", "updated")


@R.query()
def x2_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.links(_pages(spark, sf_dir))
    return found.select("page_id", "href", "label", urls.registrable_domain(F.col("href")).alias("domain"))


@R.query()
def x2_page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.cells(_pages(spark, sf_dir))


@R.query()
def x5_links_of_own_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first link of each label within the page's own site."""
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("site"))
    found = html.links(_pages(spark, sf_dir)).join(pages, "page_id").where(urls.host(F.col("href")) == F.col("site"))
    return ranking.latest(found, ["page_id", "label"], [F.col("href")]).select("page_id", "label", "href")


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: front matter from the columns, every second line a heading."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(F.when(i % 4 == 0, "## ").otherwise("### "), x)).otherwise(x))
    head = F.concat(F.lit("---\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\nsource: "), F.coalesce("source", F.lit("")), F.lit("\n---\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.array_join(lines, "\n")).alias("md"))


@R.query("select doc_id, coalesce(lang,'') as lang, coalesce(source,'') as source from documents")
def io3_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _markdown(spark, sf_dir).select("doc_id", markdown.front_matter(F.col("md")).alias("f"))
    return found.select("doc_id", F.col("f.meta")["lang"].alias("lang"), F.col("f.meta")["source"].alias("source"))


_MD_LINES = "list_transform(string_split(coalesce(text,''), chr(10)), lambda x, i: case when (i-1)%2=0 then (case when (i-1)%4=0 then '## ' else '### ' end)||x else x end)"


@R.query(rf"""with m as (select doc_id, {_MD_LINES} as l from documents), h as (select doc_id, l, unnest(range(0,len(l))) as i from m),
g as (select doc_id, l, i, l[i+1] as line, row_number() over w as section, lead(i) over w as nx from h where regexp_matches(l[i+1], '^#{{1,6}}\s+\S') window w as (partition by doc_id order by i)),
s as (select doc_id, section, length(regexp_extract(line,'^(#+)',1)) as level, trim(regexp_replace(regexp_replace(line,'^#+\s+',''),'(?:<!--.*?-->|\s#+\s*$)','','g')) as title, length(trim(array_to_string(l[i+2:coalesce(nx,len(l))],chr(10)))) as chars from g),
e as (select doc_id, section, least(min(case when level<=1 then section end) over w, case when level>=2 then min(case when level<=2 then section end) over w end, case when level>=3 then min(case when level<=3 then section end) over w end, case when level>=4 then min(case when level<=4 then section end) over w end, case when level>=5 then min(case when level<=5 then section end) over w end, case when level>=6 then min(section) over w end) as ends from s window w as (partition by doc_id order by section rows between 1 following and unbounded following))
select s.doc_id, s.section, level, title, ends, chars from s join e using (doc_id, section)""".replace("\\\\", "\\"))
def x7_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _markdown(spark, sf_dir).select("doc_id", markdown.front_matter(F.col("md"))["body"].alias("md"))
    found = markdown.heading_sections(docs, "doc_id", "md")
    return found.select("doc_id", "section", "level", "title", "ends", F.length("body").alias("chars"))


@R.query()
def x8_pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(markdown.table_rows(F.coalesce("text", F.lit("")))).alias("row", "cells"))
    return rows.select("doc_id", "row", F.size("cells").alias("n_cells"), F.element_at("cells", 1).alias("first"))


@R.query("with e as (select event_id, user_id, ts, case when event_type='purchase' then value end as mark from events) select event_id, last_value(mark ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as mark from e")
def x9_carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("mark"))
    return markdown.carried(rows, "user_id", "event_id", "mark").select("event_id", "mark")


@R.query("with f as (select page_id, url from pages where page_id%3<>0) select page_id, url, 'primary' as via from f union all select page_id, url, 'fallback' from pages where page_id not in (select page_id from f)")
def io8_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    primary = pages.where("page_id % 3 <> 0").withColumn("via", F.lit("primary"))
    return feeds.with_fallback(primary, pages.withColumn("via", F.lit("fallback")), "page_id")


@R.query("select event_id, json_extract_string(props, '$.k') as k, coalesce(json_extract_string(props,'$.none'), json_extract_string(props,'$.k')) as first from events")
def io4_mapped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, missing = feeds.mapped_json(F.col("props"), {"k": "k", "none": "none"})
    rows = table(spark, sf_dir, "events").select("event_id", k, missing)
    return rows.select("event_id", "k", F.coalesce("none", "k").alias("first"))


@R.query("select event_id, case when event_id%2=0 then 'USDTRY' else 'GRAM24' end as item, round(value,2) as buying, case when event_id%3=0 then null else round(value,2)+1000 end as selling, '2024-01-'||cast(10+event_id%9 as varchar) as data_time from events where event_id%4<>3")
def io4_mapped_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as payloads that a mapping of paths reads; some have one price, and every fourth has none."""
    n, v = F.col("event_id"), F.round("value", 2)
    turkish = lambda c: F.concat(F.lit('"'), F.translate(F.format_number(c, 2), ",.", ".,"), F.lit('"'))
    row = F.concat(F.lit('{"b": '), turkish(v), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit(', "s": '), turkish(v + 1000))), F.lit("}"))
    where = F.when(n % 4 == 3, "x").when(n % 2 == 0, "usd").otherwise("gold")
    payload = F.concat(F.lit('{"at": ["2024-01-'), (F.lit(10) + n % 9).cast("string"), F.lit('"], "'), where, F.lit('": [{}, '), row, F.lit("]}"))
    mapping = {"USDTRY": {"buy": "usd.1.b", "sell": "usd.1.s"}, "GRAM24": {"buy": "gold.1.b", "sell": "gold.1.s"}}
    rows = table(spark, sf_dir, "events").select("event_id", feeds.mapped_quotes(payload, mapping, "at.0").alias("r"))
    return rows.select("event_id", "r.data_time", F.explode("r.quotes").alias("q")).select("event_id", "q.item", F.round("q.buying", 9).alias("buying"), F.round("q.selling", 9).alias("selling"), "data_time")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("v", F.round("value", 2))


@R.query("select event_id, item, case when item='USDTRY' then round(value,2)/100 else round(value,2) end as buying, case when item='USDTRY' then (round(value,2)+1)/100 else round(value,2)+1 end as selling, case when event_id%2=0 then timestamp '2024-01-05 12:30:00' else timestamp '2024-02-03 12:30:00' end as data_time from events, (select unnest(['USDTRY','EURTRY']) as item) where event_id%3<>0 or item='EURTRY'")
def io5_reference_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as rates documents: dollars by the hundred, euros by one, and a currency that is not followed."""
    rate = lambda code, unit: F.concat(F.lit(f'<Currency CurrencyCode="{code}"><Unit>{unit}</Unit><ForexBuying>'), F.format_string("%.2f", "v"), F.lit("</ForexBuying><ForexSelling>"), F.format_string("%.2f", F.col("v") + 1), F.lit("</ForexSelling></Currency>"))
    day = F.when(F.col("event_id") % 2 == 0, 'Tarih="05.01.2024"').otherwise('Date="02/03/2024"')
    xml = F.concat(F.lit("<Rates "), day, F.lit(">"), F.when(F.col("event_id") % 3 == 0, "").otherwise(rate("USD", 100)), rate("EUR", 1), rate("JPY", 1), F.lit("</Rates>"))
    rows = _events(spark, sf_dir).select("event_id", feeds.reference_rates(xml).alias("r"))
    return rows.select("event_id", "r.data_time", F.explode("r.quotes").alias("q")).select("event_id", "q.item", F.round("q.buying", 9).alias("buying"), F.round("q.selling", 9).alias("selling"), "data_time")


@R.query("select event_id, item, case when item='GRAM24' then 4000+round(value,2) else round(value,2) end as buying, case when item='GRAM24' then null else round(value,2)+0.5 end as selling, timestamp '2024-01-02 07:30:00' as data_time from events, (select unnest(['USDTRY','GRAM24']) as item) where event_id%4<>0 or item='GRAM24'")
def io6_market_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as market payloads that name their items in turn by key, by another key, or by a label within."""
    turkish = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    name = F.when(F.col("event_id") % 3 == 0, "USD").when(F.col("event_id") % 3 == 1, "usd").otherwise("ABD DOLARI")
    dollar = F.when(F.col("event_id") % 4 == 0, '"USD": 1').otherwise(F.concat(F.lit('"'), name, F.lit('": {"Alış": "'), turkish(F.col("v")), F.lit('", "Satış": "'), turkish(F.col("v") + 0.5), F.lit('"}')))
    gold = F.concat(F.when(F.col("event_id") % 2 == 0, '"GRA": {').otherwise('"x": {"Name": "gram altın", '), F.lit('"Buying": "'), turkish(F.col("v") + 4000), F.lit('"}'))
    payload = F.concat(F.lit('{"Update_Date": "2024-01-02 10:30:00", '), dollar, F.lit(", "), gold, F.lit("}"))
    # a small table is one task's, and payloads are slow to read for their bytes
    dealt = _events(spark, sf_dir).select("event_id", "v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    rows = dealt.select("event_id", feeds.market_quotes(payload).alias("r"))
    return rows.select("event_id", "r.data_time", F.explode("r.quotes").alias("q")).select("event_id", "q.item", F.round("q.buying", 9).alias("buying"), F.round("q.selling", 9).alias("selling"), "data_time")


@R.query("select event_id, round(value,2) as temperature, round(value,2)+3 as max, case event_id%4 when 0 then 'Açık' when 1 then 'Yağmur' when 2 then 'Kar' else 'Bilinmiyor' end as description, case when event_id%4=3 then null else round(value,2)/2 end as rain, timestamp '2024-01-02 06:30:00' as data_time from events")
def io7_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as forecasts; every fourth has an unknown code and no sum of rain."""
    n, v = F.col("event_id") % 4, F.format_string("%.2f", "v")
    code = F.element_at(F.array(*map(F.lit, ("0", "63", "73", "12"))), (n + 1).cast("int"))
    rain = F.when(n == 3, "").otherwise(F.concat(F.lit(', "precipitation_sum": ['), F.format_string("%.4f", F.col("v") / 2), F.lit("]")))
    payload = F.concat(F.lit('{"current": {"time": "2024-01-02T09:30", "temperature_2m": '), v, F.lit(', "weather_code": '), code, F.lit('}, "daily": {"temperature_2m_max": ['), F.format_string("%.2f", F.col("v") + 3), F.lit(", 1.0]"), rain, F.lit("}}"))
    rows = _events(spark, sf_dir).select("event_id", feeds.forecast(payload).alias("f"))
    return rows.select("event_id", "f.current.temperature", F.col("f.today.max").alias("max"), "f.current.description", F.round("f.today.precipitation_sum", 9).alias("rain"), "f.data_time")


@R.query(f"with d as (select doc_id, source, {SQL_TITLE} as title, coalesce(text,'') as body, row_number() over (partition by source order by doc_id) as n from documents), f as (select *, row_number() over (partition by source order by doc_id) as k from d where n<=40 and contains(lower(title||' '||body), 'the')) select doc_id, source, length(substr(body,1,300)) as chars from f where k<=5")
def p19_place_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of warning feeds, a feed per source; the place is a word that many have."""
    entries = table(spark, sf_dir, "documents").select("doc_id", "source", first_line().alias("title"), "text")
    return feeds.warnings_for(entries, "source", "doc_id", "title", "text", F.lit("The")).select("doc_id", "source", F.length("summary").cast("long").alias("chars"))


@R.query("select page_id, [cast(5000000 + page_id%50 as varchar)] as kbs from pages where page_id%3<>2 and page_id%5<>0")
def p4_search_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as search results, each found twice; every third tells no issue and every fifth has no web address."""
    n = F.col("page_id")
    address = F.when(n % 5 == 0, F.concat(F.lit("ftp://a.org/"), n.cast("string"))).otherwise(F.concat(F.lit("https://a.org/p?utm_source=x&id="), n.cast("string")))
    snippet = F.when(n % 3 == 2, "all is well").otherwise(F.concat(F.lit("printer stopped working after KB"), (F.lit(5000000) + n % 50).cast("string")))
    rows = table(spark, sf_dir, "pages").select("page_id", address.alias("url"), F.lit("Report").alias("title"), snippet.alias("snippet"))
    found = feeds.search_reports(rows.union(rows), "url", "title", "snippet")
    return found.select("page_id", "kbs")


@R.query("with i as (select doc_id, source, timestamp '2024-01-01 00:00:00' + to_hours(cast(doc_id % 240 as int)) as published, trim(regexp_replace(split_part(coalesce(text,''),chr(10),1), '\\s+', ' ', 'g')) as title from documents), r as (select *, row_number() over (partition by source order by published desc, 'https://example.org/'||doc_id) as n from i where title<>'' and published >= timestamp '2024-01-04 00:00:00') select doc_id, source, published from r where n<=20".replace("\\\\", "\\"))
def io1_feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 240) * 3600)
    items = docs.select("doc_id", "source", first_line().alias("title"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("link"), F.lit(None).cast("string").alias("guid"), F.col("text").alias("description"))
    kept = feeds.entries(items.withColumn("t", at), "source", F.col("t"), F.lit("2024-01-04 00:00:00").cast("timestamp"), keep=20)
    return kept.select("doc_id", "source", F.col("at").alias("published"))


_ROUTED = "coalesce(text,'') || case doc_id%5 when 0 then ' Intune fails' when 1 then ' sccm' else '' end"


@R.query(f"with t as (select doc_id, ['community','press','news','blogs'][doc_id%4+1] as m, {SQL_PADDED.format(x=sql_fold(_ROUTED))} as t from documents), k as (select doc_id, case when m in ('community','press') then case when not regexp_matches(t, '{SQL_SCOPE}') then null when regexp_matches(t, '{SQL_ISSUE}') then 'field_report' else 'article' end when m='news' then 'article' else 'content' end as kind from t) select * from k where kind is not null")
def p3_feed_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed items of four modules; every fifth names the scope and fails, every fifth only names it."""
    module = F.element_at(F.array(F.lit("community"), F.lit("press"), F.lit("news"), F.lit("blogs")), (F.col("doc_id") % 4 + 1).cast("int"))
    n = F.col("doc_id") % 5
    told = F.concat(F.coalesce("text", F.lit("")), F.when(n == 0, " Intune fails").when(n == 1, " sccm").otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", feeds.routed(module, told, keep_articles=True).alias("kind"))
    return rows.where("kind is not null")


_PRICES = "select event_type, ts, event_id, value, lag(value) over w as p, lag(ts) over w as pt from events window w as (partition by event_type order by ts, event_id)"


@R.query(f"select event_id, round(case when pt<>ts and p<>0 then value-p end, 4) as diff, p as previous from ({_PRICES})")
def j14_price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.compared(table(spark, sf_dir, "events"), ["event_type"], "ts", "event_id", "value").select("event_id", "diff", "previous")


@R.query("with s as (select cast(ts as date) as day, count(*) filter (where event_type='error') as e from events group by 1) select day, max(case when e>60 then day end) over (order by day rows between unbounded preceding and 1 preceding) as previous from s")
def j13_previous_used_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("e"))
    days = stored(spark, days, "days")
    return daily.previous_used(days.select("day"), days.where("e > 60"), "day", "day")


@R.query("select user_id, list_sort(list_distinct(list(event_type) filter (where event_type in ('view','click','refund')))) as kept, case when count(distinct event_type) filter (where event_type in ('view','click','refund'))=3 then 'ok' when count(*) filter (where event_type in ('view','click','refund'))>0 then 'partial' else 'error' end as status from events group by 1")
def p20_quote_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("present"))
    wanted = F.array(F.lit("view"), F.lit("click"), F.lit("refund"))
    return present.select("user_id", daily.completeness(wanted, F.col("present")).alias("c")).select("user_id", "c.kept", "c.status")


@R.query("with d as (select distinct date_trunc('day', ts) as day from events) select e.event_id, d.day from events e join d on e.ts < d.day + interval 1 day and e.ts + to_hours(cast(1 + e.event_id%30 as int)) > d.day")
def j17_day_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of 1 to 30 hours with the days that they overlap."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (1 + F.col("event_id") % 30) * 3_600_000_000).alias("till"))
    days = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("day")).distinct()
    return daily.overlapping(events, days, "ts", "till", "day").select("event_id", "day")


_PLACE, _DISTRICT, _CODE = "['Kadıköy','KADIKÖY','Kadıköy Merkez'][c_custkey%3+1]", "['Kadıköy İlçesi','Üsküdar','Kadıköy Merkez ilçesi'][c_custkey%5%3+1]", "['PPL','PPLA2','PPLX',null][c_custkey%4+1]"


@R.query(f"with p as (select c_custkey, {_PLACE} as name, n_name as admin1, regexp_replace({_DISTRICT}, '\\s+(?:İlçesi|ilçesi|İli|ili)$', '') as d, {_CODE} as code from customer join nation on n_nationkey=c_nationkey), r as (select c_custkey, {sql_fold('name')}='kadikoy' as exact, coalesce(code in ('PPLC','PPLA','PPLA2'), false) or {sql_fold('name')}={sql_fold('d')} as seat from p where contains({sql_fold('admin1')}, 'n')) select * from r order by exact desc, seat desc, c_custkey limit 40")
def j16_place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places of their nations, by name; the list that a reader chooses from."""
    n = F.col("c_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("admin1"))
    places = table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(
        "c_custkey", pick(["Kadıköy", "KADIKÖY", "Kadıköy Merkez"], n % 3).alias("name"), "admin1", pick(["Kadıköy İlçesi", "Üsküdar", "Kadıköy Merkez ilçesi"], n % 5 % 3).alias("admin2"),
        F.lit(None).cast("string").alias("country"), pick(["PPL", "PPLA2", "PPLX", None], n % 4).alias("feature_code"),
    )
    return daily.ranked_places(places, "c_custkey", "Kadıköy", "N", 40).select("c_custkey", "exact", "seat")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 12 letters up that assistants use, with those that users used before in the conversation."""
    long = lambda role: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == role, F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{12,}"), F.lit(0))))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(long("assistant").alias("claims"), long("user").alias("evidence"))


@R.query("with w as (select conv_id, role, unnest(regexp_extract_all(lower(coalesce(text,'')), '[a-z]{12,}')) as x from conversations), c as (select distinct conv_id from conversations), u as (select conv_id, count(distinct x) as n from w a where role='assistant' and not exists (select 1 from w b where b.conv_id=a.conv_id and b.role='user' and b.x=a.x) group by 1) select c.conv_id, coalesce(n,0) as unsupported, coalesce(n,0)=0 as grounded from c left join u on u.conv_id=c.conv_id")
def p17_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _claims(spark, sf_dir).select("conv_id", F.size(daily.ungrounded(F.col("claims"), F.col("evidence"))).cast("long").alias("unsupported"))
    return rows.withColumn("grounded", F.col("unsupported") == 0)


@R.query("select doc_id from documents where sha256(coalesce(text,'')) not in (select sha256(coalesce(text,'')) from documents where doc_id%5=0)")
def j18_uncached_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"))
    cache = docs.where("doc_id % 5 = 0").select(F.sha2("prompt", 256).alias("prompt_hash")).distinct()
    return daily.uncached(docs, cache, "prompt").select("doc_id")


@R.query(f"with r as (select *, row_number() over (partition by source order by (lang='en') desc, doc_id) as n, {SQL_TITLE} as title from documents) select source, md5(string_agg('['||n||'] '||title||chr(10)||substr(coalesce(text,''),1,2200), chr(10)||chr(10) order by n)) as prompt_md5, count(*) as sources from r where n<=6 group by 1")
def f6_j10_prompt_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("lang") == "en").alias("official"), first_line().alias("title"), "text")
    return daily.bundle(docs, "source", "official", "doc_id", "title", "text").select("source", F.md5("prompt").alias("prompt_md5"), "sources")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; a pattern, for a stream's path may not be a single file."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("select event_type, time_bucket(interval '180 minutes', ts, timestamp '1970-01-01 00:00:00') as slot, count(*) as n from events group by 1,2")
def st1_slots_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.drained(jobs.slots(_stream(spark, sf_dir), "ts", "180 minutes", ["event_type"], "2 days"), "complete")
    return found.select("event_type", F.col("window.start").alias("slot"), "n")


@R.query("select distinct user_id, event_type, cast(ts as date) as day from events")
def st2_once_per_key_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _stream(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return jobs.drained(jobs.once(keyed, "ts", ["user_id", "event_type", "day"], "40 days"), "append").select("user_id", "event_type", "day")


@R.query("select event_id from events where ts >= timestamp '2024-01-31 00:00:00' - interval 7 days")
def st3_late_cutoff_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drained(jobs.recent(_stream(spark, sf_dir), "ts", "2024-01-31 00:00:00", 7), "append").select("event_id")


@R.query("with h as (select user_id, ts, event_id, event_type, value>50 as large, lag(struct_pack(a:=event_type,b:=value>50)) over w as p from events window w as (partition by user_id order by ts,event_id)) select user_id, event_id, event_type, large, row_number() over (partition by user_id order by ts,event_id) as version from h where p is null or p <> struct_pack(a:=event_type,b:=large)")
def st4_st6_changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withColumn("large", F.col("value") > 50)
    found = jobs.drained(jobs.changed_rows(rows, "user_id", ["ts", "event_id"], ["event_type", "large"]), "append")
    return found.select("user_id", "event_id", "event_type", "large", "version")


@R.query(state_queries.R.sql["w4_f5_material_versions"])
def st6_material_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a stream: an error after none, or a value 25 away from that of the last version."""
    material = lambda new, last: (new[0] == "error" and last[0] != "error") or abs(new[1] - last[1]) >= 25
    return jobs.drained(jobs.changed_rows(_stream(spark, sf_dir), "user_id", ["ts", "event_id"], ["event_type", "value"], material=material), "append").select("user_id", "ts", "event_id", "event_type", "value", "version")


@R.query("with a as (select user_id, ts, event_id, event_type as action, last_value(case when event_type in ('purchase','signup') then event_type end ignore nulls) over (partition by user_id order by ts,event_id rows between unbounded preceding and 1 preceding) as before from events) select user_id, coalesce(arg_max(action='purchase', struct_pack(t:=ts,e:=event_id)) filter (where action in ('purchase','signup')), false) as followed, cast(sum(case when action='purchase' then 3 when action='signup' and before='purchase' then -3 else 0 end) as bigint) as relevance_delta from a group by 1")
def st5_followed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "follow").when(F.col("event_type") == "signup", "unfollow").otherwise("view")
    return jobs.drained(jobs.followed(_stream(spark, sf_dir).withColumn("action", action), "user_id", "action", ["ts", "event_id"]), "update").select("user_id", "followed", "relevance_delta")


@R.query("select e.event_id, s.ts as signed_up from events e join events s on s.user_id=e.user_id and s.event_type='signup' and e.event_type='click' and e.ts >= s.ts and e.ts <= s.ts + interval 48 hour")
def st7_bounded_match_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _stream(spark, sf_dir).where("event_type = 'signup'").select("user_id", F.col("ts").alias("signed_up"))
    found = jobs.drained(jobs.matched(_stream(spark, sf_dir).where("event_type = 'click'"), known, "user_id", "ts", "signed_up", 48), "append")
    return found.select("event_id", "signed_up")


@R.query("select doc_id, case when lang='en' then split_part(coalesce(text,''),chr(10),1) end as canonical, coalesce(lang<>'en', true) as queued from documents")
def f7_canonical_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English rows keep their title; all others wait for a translation."""
    english = F.col("lang").startswith("en")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(english, first_line()).alias("canonical"), F.coalesce(~english, F.lit(True)).alias("queued"))


_SPACED = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_QUOTE = "case doc_id%3 when 0 then '“'||substr(coalesce(text,''),11,60)||'”.' when 1 then array_to_string(list_reverse(list_slice(string_split(coalesce(text,''),' '),2,12)),' ') else 'this never stood anywhere at all, xyzq' end"


def _quote() -> F.Column:
    body, n = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    backwards = F.array_join(F.reverse(F.slice(F.split(body, " "), 2, 11)), " ")
    return F.when(n == 0, F.concat(F.lit("“"), F.substring(body, 11, 60), F.lit("”."))).when(n == 1, backwards).otherwise("this never stood anywhere at all, xyzq")


_QUOTED = rf"""with d as (select doc_id, {_SPACED.format(x=sql_fold(_QUOTE))} as q, {_SPACED.format(x=sql_fold('text'))} as e from documents), s as (select doc_id, regexp_replace(q, '^[ .\"''“”]+|[ .\"''“”]+$', '', 'g') as q, e from d), w as (select *, regexp_extract_all(q, '[a-z0-9]+') as w, list_distinct(regexp_extract_all(e, '[a-z0-9]+')) as h from s)
select doc_id, length(q)>=8 and (contains(e,q) or (len(w)>=3 and len(list_filter(w, lambda x: list_contains(h,x))) >= 0.9*len(w))) as quoted from w""".replace('\\"', '"')


@R.query(_QUOTED)
def t30_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of each text: a part of it between marks, its words backwards, or none of its words."""
    return table(spark, sf_dir, "documents").select("doc_id", text.quoted(_quote(), F.coalesce("text", F.lit(""))).alias("quoted"))


_CUT = "case when length({x})<={n} then {x} else regexp_replace(substr({x},1,{n}-1), ' [^ ]*$', '') || '…' end"
_TITLE_CUT = _CUT.format(x=_SPACED.format(x=SQL_TITLE), n=120)


@R.query(rf"""with q as ({_QUOTED}), d as (select doc_id, {_TITLE_CUT} as title, doc_id%4=0 as unknown, trim(regexp_replace({SQL_TITLE}, '\s+', ' ', 'g'))<>'' as titled from documents)
select doc_id, titled and not unknown as accepted, case when unknown then ['KB9999999'] else [] end as unknown, case when titled and not unknown then title end as title, case when titled and not unknown then case when quoted then ['kaynak','ai_cikarim'] else ['ai_cikarim','ai_cikarim'] end end as bases from d join q using (doc_id)""")
def p17_validated_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated texts about documents: updates that the text, the state or nothing knows, and advice with a quote and without."""
    n = F.col("doc_id")
    action = lambda what, basis, quote: F.struct(F.lit(what).alias("text"), F.lit(basis).alias("basis"), quote.alias("evidence_quote"))
    actions = F.array(action("Install it.", "kaynak", _quote()), action("Wait.", "else", F.lit("")), action(" ", "kaynak", F.lit("x")), action("Too many.", "kaynak", F.lit("y")))
    summary = F.when(n % 4 == 0, "KB9999999 fixes it").otherwise("KB5000001 and KB5000002 fix it")
    evidence = F.concat(F.coalesce("text", F.lit("")), F.lit("\nKB5000001"))
    fields = {"title_tr": first_line(), "summary_tr": summary}
    rows = table(spark, sf_dir, "documents").select("doc_id", generated.validated(fields, actions, evidence, F.array(F.lit("5000002"))).alias("v"))
    return rows.select("doc_id", "v.accepted", "v.unknown", F.col("v.title_tr").alias("title"), F.col("v.actions.basis").alias("bases"))


@R.query("with v as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, struct_pack(a:=l_linestatus,b:=l_returnflag,c:=l_suppkey%3,d:=l_tax>0.05) as s, lag(struct_pack(a:=l_linestatus,b:=l_returnflag,c:=l_suppkey%3,d:=l_tax>0.05)) over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as p from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, p is null or s<>p as means_something from v")
def t29_semantic_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as versions of an order's record: whether the fields that carry meaning differ from the version before; prices and dates don't count."""
    fields = {"status": F.col("l_linestatus"), "stage": F.col("l_returnflag"), "products": F.array(F.col("l_suppkey") % 3), "price": F.col("l_extendedprice")}
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("h", text.semantic_hash(fields, F.when(F.col("l_tax") > 0.05, "Restart")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (~F.col("h").eqNullSafe(F.lag("h").over(order))).alias("means_something"))

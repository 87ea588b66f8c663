"""Scalar functions over texts and URLs as queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnline.functions import dates, fixed, labels, text, urls
from dawnline.plans.tables import Registry, table

R = Registry()

_FOLD = "strip_accents(translate(lower(translate(coalesce({c},''),'Iİ','ıi')),'ışğüöçâîû','isguocaiu'))"
_STOP = "[" + ",".join(f"'{w}'" for w in sorted(set(fixed.STOPWORDS))) + "]"
_NOISE = "[" + ",".join(f"'{w}'" for w in sorted(set(fixed.STOPWORDS) | set(fixed.DOMAIN_NOISE))) + "]"


def sql_fold(c: str) -> str:
    return _FOLD.format(c=c)


def sql_words(c: str, noise: bool = False) -> str:
    """SQL of tokens(stem=0)."""
    stop = _NOISE if noise else _STOP
    keep = f"not list_contains({stop}, w) and ((regexp_full_match(w,'[0-9]+') and length(w)>=3) or (not regexp_full_match(w,'[0-9]+') and length(w)>=2))"
    return f"list_filter(regexp_extract_all({sql_fold(c)}, '[a-z0-9]+'), lambda w: {keep})"


def sql_tokens(c: str, noise: bool = False) -> str:
    return f"list_transform({sql_words(c, noise)}, lambda w: case when regexp_full_match(w,'[0-9]+') then w else substr(w,1,5) end)"


def first_line(c: str = "text") -> F.Column:
    return F.substring_index(F.coalesce(F.col(c), F.lit("")), "\n", 1)


def told(mark: str = "doc_id") -> F.Column:
    """The document's text after sentences with update, vulnerability, build and product names that its number tells."""
    n = F.col(mark)
    number = lambda base, m: (F.lit(base) + n % m).cast("string")
    fixes = F.when(n % 3 == 0, F.concat(F.lit("The update KB"), number(5000000, 97), F.lit(" fixes it. An initial fix came in kb "), number(5000000, 89), F.lit(". ")))
    fixes = fixes.when(n % 3 == 1, F.concat(F.lit("KB"), number(5100000, 50), F.lit(" partially resolves it. "))).otherwise("")
    holes = F.when(n % 2 == 0, F.concat(F.lit("See CVE-2024-"), number(10000, 500), F.lit(" and cve-2023-1234. "))).otherwise("")
    builds = F.when(n % 4 == 0, F.concat(F.lit("Windows 11, version 24H2 (OS Build 26100."), number(1000, 300), F.lit("). ")))
    builds = builds.when(n % 4 == 1, "Windows Server 2022 has it. ").when(n % 4 == 2, "Builds 99999.123 and 17763.55 differ. ").otherwise("")
    return F.concat(fixes, holes, builds, F.coalesce("text", F.lit("")))


SQL_TOLD = """(case doc_id%3 when 0 then 'The update KB'||(5000000+doc_id%97)||' fixes it. An initial fix came in kb '||(5000000+doc_id%89)||'. ' when 1 then 'KB'||(5100000+doc_id%50)||' partially resolves it. ' else '' end || case when doc_id%2=0 then 'See CVE-2024-'||(10000+doc_id%500)||' and cve-2023-1234. ' else '' end
|| case doc_id%4 when 0 then 'Windows 11, version 24H2 (OS Build 26100.'||(1000+doc_id%300)||'). ' when 1 then 'Windows Server 2022 has it. ' when 2 then 'Builds 99999.123 and 17763.55 differ. ' else '' end || coalesce(text,''))"""
SQL_TITLE = "split_part(coalesce(text,''), chr(10), 1)"


@R.query("select doc_id, md5(lower(translate(coalesce(text,''),'Iİ','ıi'))) as lowered from documents")
def t1_turkish_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.tr_lower("text")).alias("lowered"))


@R.query(f"select doc_id, md5({sql_fold('text')}) as folded from documents")
def t2_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold("text")).alias("folded"))


@R.query(r"select doc_id, md5(trim(regexp_replace(coalesce(text,''), '\s+', ' ', 'g'))) as spaced, length(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text,''), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10)||chr(10), 'g'))) as block_chars from documents")
def t3_normal_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.norm_space("text")).alias("spaced"), F.length(text.norm_block("text")).cast("long").alias("block_chars"))


@R.query(f"select doc_id, len(t) as n_tokens, md5(array_to_string(t,' ')) as tokens_md5, len(list_distinct(t)) as n_distinct from (select doc_id, {sql_tokens('text')} as t from documents)")
def t4_t5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


_PAIR = f"""with t as (select doc_id, list_distinct({sql_tokens(SQL_TITLE)}) as a, list_distinct({sql_tokens('text')}) as b from documents),
p as (select doc_id, len(a) as na, len(b) as nb, len(list_intersect(a,b)) as ab from t),
s as (select doc_id, case when na>0 and nb>0 then ab/(na+nb-ab)::double else 0.0 end as j, case when least(na,nb)>0 then ab/least(na,nb)::double else 0.0 end as c, least(na,nb) as small from p)
select doc_id, round(j,9) as jaccard, round(c,9) as containment, round(greatest(j, case when small>=3 then 0.85*c else 0.0 end),9) as title_similarity from s"""


@R.query(_PAIR)
def t6_t7_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line against its whole text."""
    sets = table(spark, sf_dir, "documents").select("doc_id", text.token_set(first_line()).alias("a"), text.token_set("text").alias("b"))
    a, b = F.col("a"), F.col("b")
    return sets.select("doc_id", F.round(text.jaccard(a, b), 9).alias("jaccard"), F.round(text.containment(a, b), 9).alias("containment"), F.round(text.title_similarity(a, b), 9).alias("title_similarity"))


@R.query(f"with w as (select doc_id, {sql_words('text')} as w from documents) select doc_id, case when len(w)=0 then 0 when len(w)<5 then 1 else len(list_distinct(list_transform(range(1, len(w)-3), lambda i: array_to_string(w[i:i+4],' ')))) end as n_shingles from w")
def t8_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", text.tokens("text", stem=0).alias("w"))
    return words.select("doc_id", F.size(text.shingles(F.col("w"))).cast("long").alias("n_shingles"))


@R.query(r"""select doc_id, list_sort(list_distinct(regexp_extract_all({T}, '(?i)\bKB\s?(\d{6,8})\b', 1))) as kbs, list_sort(list_distinct(list_transform(regexp_extract_all({T}, '(?i)\bCVE-\d{4}-\d{4,7}\b'), lambda x: upper(x)))) as cves, list_sort(list_distinct(regexp_extract_all({T}, '\b(?:14393|17763|19044|19045|20348|22621|22631|25398|26100|26200|28000)\.\d{2,5}\b'))) as builds from documents""".replace("{T}", SQL_TOLD))
def t11_t12_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.kbs(told()).alias("kbs"), text.cves(told()).alias("cves"), text.builds(told()).alias("builds"))


_PRODUCTS = "list_sort(list_distinct(list_filter([" + ",".join(
    [f"case when regexp_matches({SQL_TOLD}, '(?i){p}') then '{x}' end" for p, x in fixed.PRODUCT_PATTERNS]
    + [rf"case when regexp_matches({SQL_TOLD}, '\b(?:{'|'.join(n)})\.\d{{2,5}}\b') then '{x}' end" for x, _, n in fixed.PRODUCTS]
) + "], lambda x: x is not null)))"


@R.query(f"select doc_id, {_PRODUCTS} as products from documents")
def t13_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.products(told()).alias("products"))


_FIX = r"""with s as (select doc_id, unnest(string_split(regexp_replace({T}, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1))) as sentence from documents),
k as (select doc_id, regexp_matches(sentence, '(?i)\bpartial(?:ly)?\b|\binitial (?:solution|fix)\b|\bresolved some\b') as part, unnest(regexp_extract_all(sentence, '(?i)\bKB\s?(\d{6,8})\b', 1)) as kb from s),
f as (select doc_id, kb, bool_or(not part) as is_full from k group by all)
select d.doc_id, coalesce(list_sort(list(kb) filter (where is_full)), []::varchar[]) as full_kbs, coalesce(list_sort(list(kb) filter (where not is_full)), []::varchar[]) as partial_kbs from documents d left join f using (doc_id) group by d.doc_id""".replace("{T}", SQL_TOLD)


@R.query(_FIX)
def t14_fix_kbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text.fix_kbs(told()).alias("f"))
    return found.select("doc_id", F.col("f.full").alias("full_kbs"), F.col("f.partial").alias("partial_kbs"))


SQL_PADDED = r"' ' || regexp_replace({x}, '\s+', ' ', 'g') || ' '"


def _sql_tag(keys: list[str]) -> str:
    import re

    clean = lambda k: re.escape(k).replace(r"\ ", " ").replace(r"\-", "-")
    short = [clean(k.strip()) for k in keys if len(k.strip()) <= 4]
    long = [clean(k) for k in keys if len(k.strip()) > 4]
    return "|".join([*(f"(?:^|[^a-z0-9])(?:{'|'.join(short)})(?:$|[^a-z0-9])" for _ in short[:1]), *long]).replace("'", "''")


_NEGATED = fixed.NEGATED.replace("'", "''")
_TAGS = (
    rf"with s as (select doc_id, array_to_string(list_filter(string_split(regexp_replace(coalesce(text,''), '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda x: not regexp_matches(x, '{_NEGATED}')), ' ') as t from documents), p as (select doc_id, {SQL_PADDED.format(x=sql_fold('t'))} as t from s) select doc_id, list_filter(["
    + ",".join(f"case when regexp_matches(t, '{_sql_tag(keys)}') then '{tag}' end" for tag, keys in fixed.SYMPTOM_TAGS.items())
    + "], lambda x: x is not null) as tags from p"
)


@R.query(_TAGS)
def t16_t17_symptom_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.symptom_tags("text").alias("tags"))


SQL_ISSUE = "|".join(fixed.ISSUE_WORDS).replace("'", "''")
SQL_SCOPE = "|".join(fixed.SCOPE_WORDS)


_SCOPED = "coalesce(text,'') || case doc_id%5 when 0 then ' Intune fails' when 1 then ' sccm' else '' end"


@R.query(f"select doc_id, regexp_matches(t, '{SQL_ISSUE}') as issue, regexp_matches(t, '{SQL_SCOPE}') as scope from (select doc_id, {SQL_PADDED.format(x=sql_fold(_SCOPED))} as t from documents)")
def t20_issue_and_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after which every fifth names the scope and fails, and every fifth only names it."""
    n = F.col("doc_id") % 5
    scoped = F.concat(F.coalesce("text", F.lit("")), F.when(n == 0, " Intune fails").when(n == 1, " sccm").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_like_issue(scoped).alias("issue"), text.in_scope(scoped).alias("scope"))


@R.query(r"with n as (select doc_id, trim(regexp_replace(coalesce(text,''), '\s+', ' ', 'g')) as t from documents) select doc_id, case when length(t)<=80 then t else regexp_replace(substr(t,1,79), ' [^ ]*$', '') || '…' end as short from n")
def t21_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate("text", 80).alias("short"))


@R.query(f"select doc_id, regexp_replace(substr(trim(regexp_replace({sql_fold(SQL_TITLE)}, '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-+$', '') as slug, substr(sha1(coalesce(text,'')),1,16) as hash from documents")
def t22_slug_and_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(first_line(), 40).alias("slug"), text.short_hash("text").alias("hash"))


@R.query("select doc_id, coalesce(nullif(lower(split_part(lang,'-',1)),''), case when regexp_matches(coalesce(text,''),'[çğıöşüİ]') then 'tr' else 'en' end) as guessed, case when regexp_matches(coalesce(text,''),'[çğıöşüİ]') then 'tr' else 'en' end as by_letters from documents")
def t23_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.language(F.col("lang"), "text").alias("guessed"), text.language(F.lit(None).cast("string"), "text").alias("by_letters"))


_PATCH = "dayofweek(o_orderdate)=2 and day(o_orderdate) between 8 and 14"


@R.query(f"select o_orderkey, {_PATCH} as patch_day, case when o_orderkey%5=0 then 'oob' when o_orderkey%3=0 then 'hotpatch' when o_orderkey%5=1 then 'preview' when {_PATCH} then 'security' else 'other' end as release from orders")
def t26_release_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as releases; the title and whether it is a hotpatch by number, the day by its date."""
    orders, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    title = F.when(n % 5 == 0, "Update (Out-of-band)").when(n % 5 == 1, "Monthly Preview").otherwise("Monthly previews")
    day = F.col("o_orderdate")
    return orders.select("o_orderkey", dates.is_patch_tuesday(day).alias("patch_day"), labels.release_type(title, n % 3 == 0, day).alias("release"))


@R.query("select o_orderkey, round(o_totalprice,2) as parsed from orders")
def t28_locale_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written the Turkish way, read back."""
    price = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.locale_number(price).alias("parsed"))


@R.query("select page_id, regexp_replace(replace(regexp_replace(url, '[?&](?:utm_[^=&]+|fbclid|gclid|ref|cmpid|at_[a-z_]+)=[^&#]*', '', 'g'), '?&', '?'), '\\?+$', '') as canonical from pages".replace("\\\\", "\\"))
def u1_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


SQL_DOMAIN = "case when len(p)>=3 and list_contains(['co','com','org','net','gov','ac'], p[-2]) and length(p[-1])=2 then array_to_string(p[-3:],'.') when len(p)>=2 then array_to_string(p[-2:],'.') else h end"
SQL_HOST = "lower(regexp_extract(coalesce(url,''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@R.query(f"with h as (select page_id, {SQL_HOST} as h from pages), p as (select page_id, h, string_split(h,'.') as p from h) select page_id, {SQL_DOMAIN} as domain from p")
def u2_registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.registrable_domain(F.col("url")).alias("domain"))


_BY_URL = "case page_id%6 when 0 then 'official' when 1 then 'press' when 2 then 'community' when 3 then 'official' when 4 then 'unknown' else case when page_id%7=0 then 'unknown' else 'community' end end"
_TRUST = "case when u='community' then 'community' when page_id%4=0 then case when u in ('official','unknown') then 'official' else u end when page_id%4=1 then 'press' else u end"


@R.query(f"select page_id, u as by_url, {_TRUST} as trust, case when {_TRUST}='official' then 'ms_official' else 'field' end as evidence, page_id%6<>5 or page_id%7<>0 as safe from (select page_id, {_BY_URL} as u from pages)")
def u3_u6_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of every class, made of the page's number, under sources of three kinds."""
    n = F.col("page_id")
    known = [("https://learn.microsoft.com/en-us/windows/p", ""), ("https://www.bleepingcomputer.com/news/p", ""), ("https://www.reddit.com/r/sysadmin/p", ""), ("https://techcommunity.microsoft.com/blog/windows-itpro-blog/p", "")]
    address = F.lit(None).cast("string")
    for i, (before, after) in enumerate(known):
        address = F.when(n % 6 == i, F.concat(F.lit(before), n.cast("string"), F.lit(after))).otherwise(address)
    address = F.when(n % 6 == 4, F.col("url")).when(n % 6 == 5, F.when(n % 7 == 0, "javascript:alert(1)").otherwise("HTTPS://GitHub.com/a/b")).otherwise(address)
    source = F.when(n % 4 == 0, "official").when(n % 4 == 1, "press").otherwise("user")
    trust = urls.effective_trust(source, address)
    return table(spark, sf_dir, "pages").select("page_id", urls.trust_of_url(address).alias("by_url"), trust.alias("trust"), urls.evidence_level(F.lit("notice"), trust).alias("evidence"), urls.is_safe(address).alias("safe"))


@R.query("select o_orderkey, cast(o_orderdate as date) as parsed from orders")
def d1_loose_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in five ways, read back."""
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    written = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "MMMM d, yyyy")).when(kind == 2, F.date_format(day, "d MMM yyyy"))
        .when(kind == 3, F.date_format(day, "M/d/yyyy")).otherwise(F.concat(F.lit("since "), F.date_format(day, "yyyy-MM-dd"), F.lit(" UTC")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(dates.parse_loose(written)).alias("parsed"))


@R.query("select event_id, cast(ts + interval 3 hour as date) as local_day, (hour(ts + interval 3 hour)*60+minute(ts + interval 3 hour)) >= 1350 or (hour(ts + interval 3 hour)*60+minute(ts + interval 3 hour)) < 450 as quiet, dayofweek(ts + interval 3 hour) between 1 and 5 as due from events")
def d2_d6_local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", dates.local_day(ts).alias("local_day"), dates.in_quiet_hours(ts, "22:30", "07:30").alias("quiet"), dates.is_due_day(ts, weekend=False).alias("due"))


_AGE = "epoch(timestamp '2024-02-01 00:00:00') - floor(epoch(ts))"


@R.query(f"with a as (select event_id, event_type, cast({_AGE} as bigint) as s from events) select event_id, case when s<90 then 'now' when s<3600 then cast(s//60 as varchar)||' min' when s<86400 then cast(s//3600 as varchar)||' h' else cast(s//86400 as varchar)||' days' end as age, case when 30 - s//86400 < 0 then 'ended' when 30 - s//86400 <= 7 then '<=7' when 30 - s//86400 <= 30 then '<=30' else '<=90' end as support, coalesce(s/3600.0 > case event_type when 'view' then 6 when 'click' then 48 when 'purchase' then 240 end, true) as stale from a")
def d4_d5_d7_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now, ts = F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("ts")
    left = (F.lit(30) - F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400)).cast("int")
    stale = dates.is_stale(F.col("event_type"), ts, now, {"view": 6, "click": 48, "purchase": 240})
    return events.select("event_id", dates.age_label(ts, now).alias("age"), dates.support_bucket(left).alias("support"), stale.alias("stale"))

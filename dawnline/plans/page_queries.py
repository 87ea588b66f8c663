"""Page grammars over documents made of the tables' rows, with SQL that tells what should be read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnline.functions import fixed
from dawnline.plans.tables import Registry, table
from dawnline.sources import extract, markdown

R = Registry()
_MONTHS = "[" + ",".join(f"'{m.capitalize()}'" for m in fixed.MONTHS_EN) + "]"


@R.query("""with l as (select o_orderkey, cast(5000000+o_orderkey//3 as varchar) as kb, cast(o_orderdate as date) as date, o_orderkey%7=0 as hot, o_orderkey%5 as k from orders where o_orderdate >= timestamp '1995-01-01 00:00:00'),
f as (select *, row_number() over (partition by kb order by date, o_orderkey) as n from l) select o_orderkey, date, kb, list_sort(list_distinct(['26100.'||(1000+o_orderkey%300), '20348.'||(2000+o_orderkey%9)])) as builds, hot as hotpatch,
case when k=0 then 'oob' when hot then 'hotpatch' when k=1 then 'preview' when dayofweek(date)=2 and day(date) between 8 and 14 then 'security' else 'other' end as release_type from f where n=1""")
def x5_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of release lists, three for each update."""
    n, day = F.col("o_orderkey"), F.col("o_orderdate")
    number = lambda x: x.cast("long").cast("string")
    suffix = F.when(n % 5 == 0, " Out-of-band").when(n % 5 == 1, " Preview").otherwise("")
    line = F.concat(
        F.date_format(day, "MMMM d, yyyy"), F.lit("—"), F.when(n % 7 == 0, "Hotpatch ").otherwise(""), F.lit("KB"), number(5000000 + F.floor(n / 3)),
        F.lit(" (OS Builds 26100."), number(1000 + n % 300), F.lit(" and 20348."), number(2000 + n % 9), F.lit(")"), suffix,
    )
    lines = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    return extract.releases(lines, "o_orderkey", "line", F.lit("1995-01-01").cast("date")).select("o_orderkey", "date", "kb", "builds", "hotpatch", "release_type")


@R.query(f"""with c as (select c_custkey, date '2024-01-01' + cast(c_custkey%900 as int) as a, date '2023-01-01' + cast(c_custkey%500 as int) as b from customer),
r as (select c_custkey, '2403' as version, a as support_end from c union all select c_custkey, '2309', b from c union all select c_custkey, '2303', null from c) select c_custkey, version, support_end, support_end - date '2024-03-01' as days_left from r where support_end is null or support_end - date '2024-03-01' > -120""")
def x10_support_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as version tables of three rows, one repeated, whose supports end by their numbers."""
    n = F.col("c_custkey")
    end = lambda first, m: F.date_format(F.date_add(F.lit(first).cast("date"), (n % m).cast("int")), "MMMM d, yyyy")
    md = F.concat(
        F.lit("| Version | Availability | Support end |\n|---|---|---|\n| [**2403**](a)<br/>(5.00.9128) | April 22, 2024 | "), end("2024-01-01", 900), F.lit(" |\n| **2309** | October 9, 2023 | "), end("2023-01-01", 500),
        F.lit(" |\n| Version 2303 | x | y |\n| **2303** | April 10, 2023 | n/a |\n| **2403** | again | January 1, 2030 |"),
    )
    docs = table(spark, sf_dir, "customer").select("c_custkey", md.alias("md"))
    return extract.support_rows(docs, "c_custkey", "md", F.lit("2024-03-01").cast("date"))


@R.query("""with c as (select c_custkey, 10000000+c_custkey//2 as kb, 2400+c_custkey%5 as v from customer) select cast(kb as varchar) as kb, 'KB'||kb||': Rollup '||min(c_custkey) as title, list_sort(list_distinct(list(cast(v as varchar)))) as versions from c group by kb having max(v) >= 2402""")
def x11_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as contents lists of one hotfix under a version; an update may stand in two lists; those of old versions only are left out."""
    n = F.col("c_custkey")
    name = F.concat(F.lit("KB"), (F.lit(10000000) + F.floor(n / 2)).cast("string"), F.lit(": Rollup "), n.cast("string"))
    yml = F.concat(F.lit("items:\n- name: Version "), (F.lit(2400) + n % 5).cast("string"), F.lit("\n  items:\n  - name: '"), name, F.lit("'\n    href: kb.md\n  - name: No page\n    href: https://x"))
    docs = table(spark, sf_dir, "customer").select("c_custkey", yml.alias("yml"))
    return extract.contents_list(docs, "c_custkey", "yml", since=2402)


@R.query("""with d as (select doc_id, doc_id%45 as k from documents) select doc_id, case when doc_id%5<>0 then date '2024-01-01' + cast(doc_id%28 as int) end as date,
list_transform(range(least(k + case when doc_id%3=0 then 1 else 0 end, 40)), lambda i: case when i<k then 'Setup stops at step '||i else 'Console is slow' end) as fixed_issues,
case when doc_id%4=0 then '' else 'Update '||doc_id||' for sites.' end as summary, doc_id%4 = 0 and k = 0 and doc_id%3<>0 as bare from d""")
def x11_hotfix_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hotfix pages of up to 44 fixed issues; some have a second such part, none of it, no summary, or no date."""
    n = F.col("doc_id")
    date = F.when(n % 5 == 0, "soon").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 28).cast("int")), "MM/dd/yyyy"))
    items = F.transform(F.sequence(F.lit(0), F.lit(44)), lambda i: F.when(i < n % 45, F.concat(F.lit("\n- **Setup  stops at step "), i.cast("string"), F.lit("** and waits."))).otherwise(""))
    more = F.when(n % 3 == 0, "\n## Also Fixed\n* **No dash**\n- **Console is slow**").otherwise("")
    summary = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("\n## Summary of the update\n**Update "), n.cast("string"), F.lit("** for [sites](a.md).")))
    md = F.concat(F.lit("---\ntitle: x\nms.date: "), date, F.lit("\n---\n# Update"), summary, F.lit("\n## Issues that are fixed"), F.array_join(items, ""), F.lit("\n### Fixed below\n- **Not of the part**"), more, F.lit("\n## Files\n- **Not an issue**"))
    found = extract.hotfix_details(table(spark, sf_dir, "documents").select("doc_id", md.alias("md")), "doc_id", "md")
    return found.select("doc_id", "date", "fixed_issues", "summary", ((F.size("fixed_issues") == 0) & (F.col("summary") == "")).alias("bare"))


@R.query("""with d as (select doc_id, unnest(range(least(doc_id%6, 3))) as i from documents) select doc_id, cast(2409+2*i as varchar) as version, case when i<2 then make_date(2024, cast(9+2*i as int), 1) end as published,
'Feature '||i||' of '||doc_id||chr(10)||'Details'||chr(10)||'more' as body from d""")
def x12_preview_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of up to five preview versions, of which the first three are read; a third one has no month."""
    n = F.col("doc_id")
    note = lambda i: F.concat(F.lit("\n### Technical preview version "), (2409 + 2 * i).cast("string"), F.lit("\nFeature "), i.cast("string"), F.lit(" of "), n.cast("string"), F.lit("\n#### Details\n**more**\n### Other notes\nx"))
    notes = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i < n % 6, note(i)).otherwise(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Previews"), F.array_join(notes, "")).alias("md"))
    return extract.preview_notes(docs, "doc_id", "md")


_DONE, _PARTLY = "Fixed in KB", "KB{} resolves it partially."


@R.query("""with d as (select doc_id, 5000000+doc_id%97 as a, 5000000+doc_id%89 as b from documents), r as (select doc_id, 3 as section, 'Printing is slow' as title, ['printing','performance'] as tags, [cast(a as varchar)] as fix_kbs, case when a<>b then [cast(b as varchar)] else [] end as partial_fix_kbs, ['2403','2409'] as versions from d
union all select doc_id, 4, 'VPN drops', ['vpn'], [], [], [] from d where doc_id%3=0) select doc_id, section, title, tags, fix_kbs, partial_fix_kbs, versions from r""")
def x6_x12_issue_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles with a section of known issues: one issue or two, after a heading of another kind, before one more."""
    n = F.col("doc_id")
    number = lambda m: (F.lit(5000000) + n % m).cast("string")
    first = F.concat(F.lit("# Article\n## Known issues\n### Printing is slow\nApplies to: versions 2403 and 2409\nThe spooler waits. It is fixed in KB"), number(97), F.lit(". An initial fix is KB"), number(89), F.lit(".\n"))
    second = F.when(n % 3 == 0, "### VPN drops\nThe tunnel ends.\n").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(first, second, F.lit("## Improvements\n### Not an issue\nKB5999999")).alias("md"))
    found = extract.issue_sections(markdown.heading_sections(docs, "doc_id", "md"), "doc_id")
    return found.select("doc_id", F.col("section").cast("int").alias("section"), "title", "tags", "fix_kbs", "partial_fix_kbs", "versions")


@R.query("""with d as (select doc_id, 7000000+doc_id as id from documents), r as (select doc_id, 'App for macOS (preview)' as title, 'Apps' as category, 'May 6, 2024' as week, '2405' as service, [cast(id as varchar)] as work_items, 'public_preview' as stage, 'feature' as change_kind, ['macos'] as platforms from d
union all select doc_id, 'Old setting will be removed', 'Devices', 'April 29, 2024', null, [], 'ga', 'deprecation', ['windows','ios'] from d where doc_id%2=0) select * from r""")
def x9_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of news by week and category, of which the two newest weeks are read."""
    n = F.col("doc_id")
    md = F.concat(
        F.lit("## Week of May 6, 2024 (Service release 2405)\n### Apps\n#### App for macOS (preview)<!-- "), (F.lit(7000000) + n).cast("string"), F.lit(" -->\nNew.\n\nApplies to:\n\n- macOS\n\n## Week of April 29, 2024\n### Devices\n"),
        F.when(n % 2 == 0, "#### Old setting will be removed\nBody.\n\nApplies to:\n\n- Windows\n- iOS/iPadOS\n").otherwise(""), F.lit("## Week of April 22, 2024\n### Apps\n#### Too old\nx\n## Notices\n### Plan\n#### Not of a week\n"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", md.alias("md"))
    found = extract.feature_sections(docs, "doc_id", "md", weeks=2)
    return found.select("doc_id", "title", "category", "week", "service", "work_items", "stage", "change_kind", "platforms")


@R.query("""with p as (select page_id, 5000000+page_id%83 as kb from pages), r as (select page_id, 'i1' as anchor, 'Sign in fails' as title, 'resolved' as status, [cast(kb as varchar)] as originating_kbs, list_sort(list_distinct([cast(kb+1 as varchar), cast(kb+case when page_id%3=0 then 1 else 2 end as varchar)])) as resolving_kbs, 'Restart.' as workaround, true as structure_ok from p
union all select page_id, 'i2', 'Sound is gone', 'confirmed', [], [], null, page_id%2=0 from p) select * from r""")
def x3_status_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as status pages: two rows of a summary, with their details, of which every second page lacks one."""
    n = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", (F.lit(5000000) + n % 83).alias("kb"))
    s = lambda x: F.lit(x)
    issue = lambda anchor, title, status, kb: F.struct(s(anchor).alias("anchor"), s(title).alias("title"), status.alias("status"), kb.alias("kb"))
    rows = pages.select("page_id", F.inline(F.array(issue("i1", "Sign in fails", F.concat(s("Resolved KB"), (F.col("kb") + F.when(n % 3 == 0, 0).otherwise(2)).cast("string")), F.concat(s("KB"), F.col("kb").cast("string"))), issue("i2", "Sound is gone", s("Confirmed"), s("")))))
    told = F.concat(s("Users can't sign in.\nWorkaround: Restart.\nResolution: Fixed in KB"), (F.col("kb") + 1).cast("string"), s(". Also fixed in KB"), F.col("kb").cast("string"), s("."))
    body = lambda anchor, text: F.struct(s(anchor).alias("anchor"), text.alias("body"))
    details = pages.select("page_id", F.inline(F.when(F.col("page_id") % 2 == 0, F.array(body("i1", told), body("i2", s("No sound.")))).otherwise(F.array(body("i1", told)))))
    return extract.status_issues(rows, details, "page_id").select("page_id", "anchor", "title", "status", "originating_kbs", "resolving_kbs", "workaround", "structure_ok")


@R.query("select page_id, 'Safeguard '||page_id as title, timestamp '2024-01-05 18:00:00' as at from pages where page_id%4<>0")
def x4_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as tables of announcements; every fourth has no date and is none."""
    n = F.col("page_id")
    cell = lambda row, col, text: F.struct(F.lit(0).alias("tab"), F.lit(row).alias("row"), F.lit(col).alias("col"), text.alias("text"))
    date = F.when(n % 4 == 0, "soon").otherwise("2024-01-05 10:00 PT")
    cells = table(spark, sf_dir, "pages").select("page_id", F.inline(F.array(cell(0, 0, F.lit("Message")), cell(0, 1, F.lit("Date")), cell(1, 0, F.concat(F.lit("Safeguard "), n.cast("string"))), cell(1, 1, date))))
    return extract.announcements(cells, "page_id").select("page_id", "title", "at")

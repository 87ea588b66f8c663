"""Grammars of HTML pages over pages made of the tables' rows; their SQL tells from the rows what should be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnline.plans import page_queries
from dawnline.plans.tables import Registry, table
from dawnline.sources import articles, extract, status_pages, tree

R = Registry()

#: Orders whose pages a task parses, so that what it holds of them is bounded.
ORDERS_OF_TASK = 20_000


def _filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns."""
    parts, rest = [], template
    while rest:
        before, mark, rest = rest.partition("{")
        parts.append(F.lit(before))
        if mark:
            name, _, rest = rest.partition("}")
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


_SYMPTOMS = ["Users cannot sign in.", "Printing is slow.", "The VPN tunnel drops.", "The recovery key is asked for.", "It does not affect Outlook users.", "Sound is gone."]
_RESOLUTIONS = ["Fixed in KB{fixing}.", "An initial fix is KB{fixing}.", "Fixed in KB{origin}.", "A Known Issue Rollback is on its way."]


def parallel(spark: SparkSession) -> int:
    """As many partitions as a shuffle has: parsing is slow for its bytes, by which small shuffles are put together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _issue(o: Column) -> tuple[Column, Column]:
    """The row of a summary and the section that tell of an order; null where there is none."""
    k = o["o_orderkey"]
    number = lambda base, n: (F.lit(base) + k % n).cast("long")
    origin = number(5000000, 1000)
    values = {
        "k": k, "id": (k + 100).cast("long"), "origin": origin, "fix": F.when(k % 13 == 0, origin).otherwise(number(5100000, 900)), "fixing": number(5200000, 800), "build": number(1000, 500),
        "priority": o["o_orderpriority"], "state": o["o_orderstatus"], "day": F.date_format(o["o_orderdate"], "yyyy-MM-dd"),
    }
    told = lambda template: _filled(template, **values)
    pick = lambda n, options: F.element_at(F.array(*map(told, options)), (k % n + 1).cast("int"))
    values["status"] = F.when(k % 11 == 0, F.lit("")).when(o["o_orderstatus"] == "F", pick(4, ["Resolved KB{fix}", "Resolved External", "Resolved", "Resolved"])).when(o["o_orderstatus"] == "P", pick(2, ["Mitigated", "Mitigated External"])).otherwise(pick(2, ["Confirmed", "Investigating"]))
    values["symptom"], values["resolution"] = pick(6, _SYMPTOMS), F.element_at(F.array(*map(told, _RESOLUTIONS)), F.least(k % 5 + 1, F.lit(4)).cast("int"))
    row = told('<tr><td><b>Issue {k} of {priority}</b><br>Total {state}<p><a href="#{id}msgdesc">See details</a><td>OS Build 26100.{build}<br>KB{origin}<td>{status}<td>{day} 10:00 UTC</tr>')
    section = F.concat(
        told('<div><h3 id="{id}msgdesc">Issue {k} of {priority}</h3><table><tr><th>Status</th><th>Originating update</th><th>History</th></tr><tr><td>Confirmed</td><td>KB{origin}</td><td>Last updated: {day}, 11:30 UTC<br>Opened: {day}, 09:00 UTC</td></tr></table><script>var x = "Workaround: none";</script><p>{symptom}</p>'),
        F.when(k % 3 == 0, told("<p>Workaround: Restart the spooler &amp; wait {k} minutes.</p>")).otherwise(""), told("<p>Resolution: {resolution}"),
        F.when(k % 2 == 0, "<p>Affected platforms:<ul><li>Client: Windows 11, version 24H2<li>Server: None</ul>").otherwise(""),
    )
    return F.when(k % 7 != 3, row), F.when(k % 5 != 4, section)


def _status_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as status pages, whose orders are issues: in the summary, in a section, or both; sections are nested in each other."""
    fields = ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate"]
    orders = table(spark, sf_dir, "orders")
    # orders are dealt and gathered as they are, and made pages of where they are parsed: no page goes through a shuffle
    parts = max(parallel(spark), orders.count() // ORDERS_OF_TASK)
    own = orders.select(F.col("o_custkey").alias("c_custkey"), F.struct(*fields).alias("o"))
    rows = own.union(table(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast(own.schema["o"].dataType)))
    found = rows.repartition(parts, "c_custkey").groupBy("c_custkey").agg(F.array_sort(F.collect_list("o")).alias("orders"), F.max(F.col("o").isNull()).alias("is_page")).where("is_page")
    joined = lambda i: F.array_join(F.transform("orders", lambda o: _issue(o)[i]), "")
    head = F.when(F.col("c_custkey") % 10 == 0, "").otherwise("<table><tr><th>Summary</th><th>Originating update</th><th>Status</th><th>Last updated</th></tr>")
    html = F.concat(F.lit("<html><body><nav><a href='#100msgdesc'>Menu</a></nav><main><h1>Status</h1>"), head, F.when(head != "", joined(0)).otherwise(""), F.lit("</table><h2>Details</h2>"), joined(1), F.lit("<h2>More</h2><p>Workaround: no issue</main>"))
    return status_pages.read(tree.trees(found.select("c_custkey", html.alias("html")), "c_custkey", "html"), "c_custkey")


_ISSUES = """with k as (
  select c_custkey, o_orderkey k, 'Issue '||o_orderkey||' of '||o_orderpriority title, o_orderstatus s, o_orderdate d, 5000000+o_orderkey%1000 origin, c_custkey%10<>0 and o_orderkey%7<>3 has_row, o_orderkey%5<>4 has_section
  from customer join orders on o_custkey=c_custkey),
i as (select *, case when not has_row or k%11=0 then case when has_section then 'Confirmed' else '' end
    when s='F' then case k%4 when 0 then 'Resolved KB'||case when k%13=0 then origin else 5100000+k%900 end when 1 then 'Resolved External' else 'Resolved' end
    when s='P' then case k%2 when 0 then 'Mitigated' else 'Mitigated External' end when k%2=0 then 'Confirmed' else 'Investigating' end raw from k where has_row or has_section)"""


@R.query(_ISSUES + """ select c_custkey, cast(k+100 as varchar) issue_id, title, case when raw like 'Resolved KB%' then 'resolved' when raw='' then 'unknown' else replace(lower(raw), ' ', '_') end status, [cast(origin as varchar)] originating_kbs,
  list_sort(list_filter([case when raw like 'Resolved KB%' then substr(raw, 12) end, case when has_section and k%5=0 then cast(5200000+k%800 as varchar) end], lambda x: x is not null and x <> cast(origin as varchar))) resolving_kbs,
  case when has_section and k%5=1 then [cast(5200000+k%800 as varchar)] else [] end partial_fix_kbs, case when has_section and k%3=0 then 'Restart the spooler & wait '||k||' minutes.' else '' end workaround,
  case when not has_section then [] else [['auth'], ['printing', 'performance'], ['vpn'], ['bitlocker'], [], ['audio']][k%6+1] end tags, has_section and k%5=3 rollback,
  case when has_section then date_trunc('day', d) + interval 9 hour end opened, case when has_section then date_trunc('day', d) + interval 690 minute end last_updated, case when has_row then date_trunc('day', d) + interval 10 hour end updated,
  case when has_section and k%2=0 then 'Windows 11, version 24H2' end client, case when has_section and k%2=0 then ['win11-24h2'] else [] end products, has_section detailed from i""")
def x3_status_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = status_pages.status_issues(_status_pages(spark, sf_dir), "c_custkey")
    return found.select("c_custkey", "issue_id", "title", "status", "originating_kbs", "resolving_kbs", "partial_fix_kbs", "workaround", "tags", "rollback", "opened", "last_updated", "updated", F.col("platforms")["client"].alias("client"), "products", "detailed")


@R.query(_ISSUES + """ select c.c_custkey, cast(c.c_custkey%10<>0 as bigint) tables, count(k) issues, c.c_custkey%10<>0 or count(k)>0 structure_ok from customer c left join i on i.c_custkey=c.c_custkey group by c.c_custkey""")
def x3_page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which status pages have a known layout: those without a table and a section have not."""
    found = _status_pages(spark, sf_dir)
    return status_pages.structure(found, status_pages.status_issues(found, "c_custkey"), "c_custkey")


_LAYOUTS = [
    "<details><summary>{brand} fails</summary><p><strong>Symptoms</strong></p><p>After installing KB{old} printing is slow.</p><p><b>Workaround:</b></p><p>Restart.</p><h4>Resolution</h4><p>This issue is resolved in KB{new}.</p></details>"
    "<div><details><summary>Second</summary><p>Sound is gone.</p><p><strong>Next steps</strong></p><p>It is partially resolved in KB{new}.</p></details></div><table><tr><th>Symptom</th></tr><tr><td>Not read</td></tr></table>",
    "<div><table><tr><th>Applies to</th><th>Symptom</th><th>Workaround</th></tr><tr><td>All<td><b>VPN drops</b> after KB{new}.<td>Wait.<tr><td>{brand}<td>Sign in fails. Try later.<td></table></div><h3>Not read</h3><p>x</p>",
    "<p>Intro</p><h3>BitLocker loops</h3><p>The recovery key is asked for.</p><p>Workaround: Type it.</p><p><strong>Sound is gone</strong></p><p>Since KB{old}.</p>",
    "<p>Devices may be slow. Resolution: It has been fixed in KB{new}.</p>",
    "<p>We are not currently aware of any issues with this update.</p>",
]


@R.query("""with p as (select p_partkey n, p_brand brand, cast(5000000+p_partkey as varchar) kb, cast(4000000+p_partkey%500 as varchar) old, cast(6000000+p_partkey as varchar) new, p_size%5 layout from part),
r as (select n, kb, 'details' layout, brand||' fails' title, 'After installing KB'||old||' printing is slow.'||chr(10)||chr(10)||'Workaround: Restart.'||chr(10)||chr(10)||'Resolution: This issue is resolved in KB'||new||'.' body, 'resolved' status, [old] originating_kbs, [new] resolving_kbs, [] partial_fix_kbs, 'Restart.' workaround, ['printing', 'performance'] tags from p where layout=0
union all select n, kb, 'details', 'Second', 'Sound is gone.'||chr(10)||chr(10)||'Resolution: It is partially resolved in KB'||new||'.', 'mitigated', [kb], [], [new], '', ['audio'] from p where layout=0
union all select n, kb, 'table', 'VPN drops', 'VPN drops after KB'||new||'.'||chr(10)||chr(10)||'Workaround: Wait.', 'confirmed', [new], [], [], 'Wait.', ['vpn'] from p where layout=1
union all select n, kb, 'table', 'Sign in fails', 'Sign in fails. Try later.', 'confirmed', [kb], [], [], '', ['auth'] from p where layout=1
union all select n, kb, 'headings', 'BitLocker loops', 'The recovery key is asked for.'||chr(10)||'Workaround: Type it.'||chr(10)||chr(10)||'Workaround: Type it.', 'confirmed', [kb], [], [], 'Type it.', ['bitlocker'] from p where layout=2
union all select n, kb, 'headings', 'Sound is gone', 'Since KB'||old||'.', 'confirmed', [old], [], [], '', ['audio'] from p where layout=2
union all select n, kb, 'whole', 'KB'||kb||' bilinen sorun', 'Devices may be slow. Resolution: It has been fixed in KB'||new||'.'||chr(10)||chr(10)||'Resolution: It has been fixed in KB'||new||'.', 'resolved', [new], [], [], '', ['performance'] from p where layout=3)
select n p_partkey, kb, case when n%2=0 then 'issues' else 'known-issues' end anchor, layout, title, body, status, originating_kbs, resolving_kbs, partial_fix_kbs, workaround, tags from r""")
def x6_article_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as articles whose known issues stand in details blocks, a table, below headings, as one text, or nowhere."""
    n = F.col("p_partkey")
    values = {"brand": F.col("p_brand"), "old": (F.lit(4000000) + n % 500).cast("long"), "new": (F.lit(6000000) + n).cast("long")}
    known = F.element_at(F.array(*(_filled(t, **values) for t in _LAYOUTS)), (F.col("p_size") % 5 + 1).cast("int"))
    heading = F.when(n % 2 == 0, "<h2 id=issues>Known issues in this update</h2>").otherwise("<h2>Known issues</h2>")
    html = F.concat(F.lit("<body><main><h1>Article</h1><h2>Summary</h2><details><summary>Fixes</summary><p>KB1111111</p></details>"), heading, known, F.lit("<h2>How to get it</h2><details><summary>Not an issue</summary><p>x</p></details></main>"))
    pages = table(spark, sf_dir, "part").select("p_partkey", (F.lit(5000000) + n).cast("long").cast("string").alias("kb"), html.alias("html"))
    found = articles.article_issues(articles.read(tree.trees(pages.repartition(parallel(spark)), "p_partkey", "html", ["kb"]), "p_partkey"), "p_partkey")
    return found.select("p_partkey", "kb", "anchor", "layout", "title", "body", "status", "originating_kbs", "resolving_kbs", "partial_fix_kbs", "workaround", "tags")


@R.query(page_queries.R.sql["x10_support_rows"])
def x10_support_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version tables of customers as HTML, after one that is none, with a row of two cells and before a second table."""
    n = F.col("c_custkey")
    end = lambda first, m: F.date_format(F.date_add(F.lit(first).cast("date"), (n % m).cast("int")), "MMMM d, yyyy")
    head = "<table><tr><th>Version</th><th>Availability</th><th>Support end date</th></tr>"
    html = F.concat(
        F.lit("<main><table><tr><th>Version</th><th>Notes</th></tr><tr><td>2111</td><td>x</td><td>y</td></tr></table>" + head + "<tr><td><b>2403</b><br>(5.00.9128)</td><td>April 22, 2024</td><td>"), end("2024-01-01", 900),
        F.lit("</td></tr><tr><td>2207</td><td>short</td></tr><tr><td>2309</td><td>October 9, 2023</td><td>"), end("2023-01-01", 500),
        F.lit("</td></tr><tr><td>2303</td><td>April 10, 2023</td><td>n/a</td></tr><tr><td>2403</td><td>again</td><td>January 1, 2030</td></tr></table>" + head + "<tr><td>2503</td><td>x</td><td>n/a</td></tr></table></main>"),
    )
    pages = table(spark, sf_dir, "customer").select("c_custkey", html.alias("html")).repartition(parallel(spark), "c_custkey")
    return extract.support_tables(tree.trees(pages, "c_custkey", "html"), "c_custkey", F.lit("2024-03-01").cast("date"))


@R.query(page_queries.R.sql["x11_contents"])
def x11_contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents lists of customers as HTML: a link under a version and a heading without one, after a link outside of the content."""
    n = F.col("c_custkey")
    name = F.concat(F.lit("KB"), (F.lit(10000000) + F.floor(n / 2)).cast("string"), F.lit(": Rollup "), n.cast("string"))
    html = F.concat(F.lit("<nav><a href='x'>KB99999999 elsewhere</a></nav><main><h2>Version "), (F.lit(2400) + n % 5).cast("string"), F.lit("</h2><h3>Updates</h3><ul><li><a href='a'>"), name, F.lit("</a></li><li><a>KB88888888 no link</a></li><li><a href='b'>No number</a></li></ul></main>"))
    pages = table(spark, sf_dir, "customer").select("c_custkey", html.alias("html")).repartition(parallel(spark), "c_custkey")
    return extract.contents_pages(tree.trees(pages, "c_custkey", "html"), "c_custkey", since=2402)

"""Page grammars on literals."""

import datetime

from pyspark.sql import functions as F

from dawnline.sources import extract, html, markdown, tree


def test_releases(spark):
    lines = [
        (1, "September 9, 2025—KB5065426 (OS Build 26100.6584)"),
        (1, "August 29, 2025—KB5064081 (OS Build 26100.5074) Preview"),
        (2, "August 29, 2025—KB5064081 (OS Build 26100.5074) Preview"),
        (1, "July 1, 2025—Hotpatch KB5000001 (OS Builds 26100.1 and 26100.12) x"),
        (1, "January 2, 2020—KB4000001 (OS Build 17763.10)"),
        (1, "no release"),
    ]
    got = extract.releases(spark.createDataFrame(lines, "p long, l string"), "p", "l", F.lit("2025-01-01").cast("date")).orderBy("date").collect()
    assert [(r["kb"], r["release_type"], r["builds"]) for r in got] == [("5000001", "hotpatch", ["26100.12"]), ("5064081", "preview", ["26100.5074"]), ("5065426", "security", ["26100.6584"])]


def test_support_rows(spark):
    md = "| Version | Available | End |\n|--|--|--|\n| **2503** (5.00.9135) | March 31, 2025 | September 30, 2026 |\n| **2203** | April 6, 2022 | October 6, 2023 |\n| **2503** | x | x |"
    got = extract.support_rows(spark.createDataFrame([(1, md)], "d long, md string"), "d", "md", F.lit("2026-09-01").cast("date")).collect()
    assert [(r["version"], r["support_end"], r["days_left"]) for r in got] == [("2503", datetime.date(2026, 9, 30), 29)]


def test_contents_list(spark):
    yml = "- name: Version 2503\n  items:\n  - name: KB31909343 rollup\n    href: 2503/a.md\n- name: Version 2409\n  items:\n  - name: KB31909343 rollup\n    href: 2409/a.md\n  - name: no number\n    href: b.md\n  - name: KB30385346 fix\n    href: c.md"
    got = extract.contents_list(spark.createDataFrame([(1, yml)], "d long, y string"), "d", "y").orderBy("kb").collect()
    assert [(r["kb"], r["versions"]) for r in got] == [("30385346", ["2409"]), ("31909343", ["2409", "2503"])]


def test_issue_sections(spark):
    md = "# Notes\n## Known issues\n### VPN drops\nApplies to: version 2403, 2409\nFixed by KB5000002. Partially resolved in KB5000001.\n## Other\n### None\ntext"
    sections = markdown.heading_sections(spark.createDataFrame([(1, md)], "d long, md string"), "d", "md")
    row = extract.issue_sections(sections, "d").collect()
    assert [(r["title"], r["tags"], r["fix_kbs"], r["partial_fix_kbs"], r["versions"]) for r in row] == [("VPN drops", ["vpn"], ["5000002"], ["5000001"], ["2403", "2409"])]


def test_status_issues(spark):
    rows = spark.createDataFrame([("p", "a1", "Printer fails", "Mitigated", "KB5000009"), ("p", "a2", "x", "Confirmed", "")], "page string, anchor string, title string, status string, kb string")
    details = spark.createDataFrame([("p", "a1", "Workaround: restart the spooler\nResolution: fixed in KB5000010")], "page string, anchor string, body string")
    got = extract.status_issues(rows, details, "page").orderBy("anchor").collect()
    assert (got[0]["status"], got[0]["originating_kbs"], got[0]["resolving_kbs"], got[0]["workaround"], got[0]["structure_ok"]) == ("mitigated", ["5000009"], ["5000010"], "restart the spooler", True)
    assert (got[1]["workaround"], got[1]["structure_ok"]) == (None, False)


def test_announcements(spark):
    page = "<table><tr><th>Message</th><th>Date</th></tr><tr><td>Change ahead</td><td>2026-09-14 10:00 PT</td></tr><tr><td>x</td><td>none</td></tr></table>"
    cells = html.cells(html.parsed(spark.createDataFrame([(1, "https://a.org", page)], "page_id long, url string, html string")))
    got = extract.announcements(cells, "page_id").collect()
    assert [(r["title"], r["at"]) for r in got] == [("Change ahead", datetime.datetime(2026, 9, 14, 17))]


def test_summary_text(spark):
    row = spark.createDataFrame([("issue", "T", "It fails. Always.", ["vpn"], ["1234567"])], "k string, t string, b string, g array<string>, f array<string>")
    assert row.select(extract.summary_text(*map(F.col, "ktbgf"))).first()[0] == "It fails. Always. Touches: vpn. Fixed by KB1234567."


def test_contents_list_tells_all_versions_of_what_it_keeps(spark):
    yml = "- name: Version 2503\n  items:\n  - name: KB31909343 rollup\n    href: a.md\n- name: Version 2203\n  items:\n  - name: KB31909343 rollup\n    href: b.md\n  - name: KB14480034 old\n    href: c.md"
    docs = spark.createDataFrame([(1, yml), (2, "- name: KB30385346 of no version\n  href: d.md")], "d long, y string")
    got = {r["kb"]: r["versions"] for r in extract.contents_list(docs, "d", "y", since=2400).collect()}
    assert got == {"31909343": ["2203", "2503"], "30385346": []}
    assert spark.range(1).select(extract.first_version(F.lit("2026-11-28").cast("date")).alias("v")).collect()[0]["v"] == 2400


def test_hotfix_details(spark):
    page = "---\ntitle: Rollup\nms.date: 04/22/2025\n---\n# KB1\n## Summary of KB1\nThis **rollup** is for `2503`.\n\n## Issues that are fixed\n\n- **Client   setup** fails.\n  - **Nested** one.\n* **Star** is none\n- plain\n### Details\n- **Not this**\n## Also FIXED\n- **Last**\n## Files\n- **No**"
    fenced = "## Fixed\n```\n## Files\n- **In code**\n```\n- **After code**"
    docs = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, fenced), (5, "## Fixed\n" + "- **x**\n" * 50000)], "d long, md string")
    got = {r["d"]: r for r in extract.hotfix_details(docs, "d", "md").collect()}
    assert got[1]["fixed_issues"] == ["Client setup", "Nested", "Last"] and got[1]["date"] == datetime.date(2025, 4, 22)
    assert got[1]["summary"].strip() == "This rollup is for 2503." and "KB1" in got[1]["text"] and "ms.date" not in got[1]["text"]
    assert all(got[d]["fixed_issues"] == [] and got[d]["summary"] == "" and got[d]["date"] is None for d in (2, 3))
    assert got[4]["fixed_issues"] == ["In code", "After code"] and len(got[5]["fixed_issues"]) == 40 and len(got[5]["text"]) == 8000


def test_preview_notes(spark):
    page = "---\na: b\n---\n## Notes\n### Technical preview version 2411\nNew\n#### Deeper\nmore\n### technical Preview version 2413\n### Not one\n### Technical preview version 2405\n### Technical preview version 2403\n## Technical preview version 2401"
    docs = spark.createDataFrame([(1, page), (2, None)], "d long, md string")
    got = extract.preview_notes(docs, "d", "md").orderBy(F.desc("version")).collect()
    assert [(r["version"], r["published"]) for r in got] == [("2413", None), ("2411", datetime.date(2024, 11, 1)), ("2405", datetime.date(2024, 5, 1))]
    assert got[1]["body"] == "New\nDeeper\nmore"


def test_support_tables_of_html(spark):
    head = "<table><thead><tr><th>Version</th><th>Available</th><th>Support  end date</th></tr></thead>"
    page = f"<main>{head}<tr><td>2103</td><td>x</td><td>October 5, 2022</td></tr></table>{head}<tr><td><strong>2503</strong><br>(5.00.9135)</td><td>March 31, 2025</td><td>September 30, 2026</td></tr><tr><td>no number</td><td>x</td><td>y</td></tr></table></main>"
    pages = tree.trees(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>2503</p>")], "d long, html string"), "d", "html")
    got = extract.support_tables(pages, "d", F.lit("2026-09-01").cast("date")).collect()
    assert [(r["d"], r["version"], r["support_end"], r["days_left"]) for r in got] == [(1, "2503", datetime.date(2026, 9, 30), 29)]  # the first table has no row to keep


def test_contents_pages(spark):
    page = "<main><a href='z'>KB30000001 before</a><h2>Version 2503</h2><a href='a'>KB31909343  rollup</a><h3>More</h3><a href='b'>KB 30385346 fix</a><h2>Version 2203</h2><a href='c'>KB31909343 again</a><a href='d'>KB14480034 old</a></main>"
    pages = tree.trees(spark.createDataFrame([(1, page), (2, None)], "d long, html string"), "d", "html")
    got = {r["kb"]: (r["title"], r["versions"]) for r in extract.contents_pages(pages, "d", since=2400).collect()}
    assert got == {"30000001": ("KB30000001 before", []), "31909343": ("KB31909343 rollup", ["2203", "2503"]), "30385346": ("KB 30385346 fix", ["2503"])}

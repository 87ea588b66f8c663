"""Page trees, status pages, articles and long documents on literals."""

import datetime
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from dawnline.functions import text
from dawnline.sources import articles, markdown, status_pages, tree


def parsed(html):
    page = tree.Tree()
    page.feed(html)
    page.close()
    return page


def told(page, node):
    e = page.elements[node]
    return " ".join("".join(page.pieces[e[tree.AT] : e[tree.END]]).split())


def test_tree_closes_what_is_left_open():
    page = parsed("<main><ul><li>a<li>b <b>x</b></ul><p>one<p>two<table><tr><td>1<td><a href='#p'>2</a><tr><td>3</table>after<script>no</script></main>tail")
    tags = [e[tree.TAG] for e in page.elements]
    assert tags == ["main", "ul", "li", "li", "b", "p", "p", "table", "tr", "td", "td", "a", "tr", "td", "script"]
    assert [told(page, i) for i, t in enumerate(tags) if t in ("li", "p", "td")] == ["a", "b x", "one", "two", "1", "2", "3"]
    assert page.cells == [(7, 0, 0, False, 9), (7, 0, 1, False, 10), (7, 1, 0, False, 13)]
    main = page.elements[0]
    assert (page.root, main[tree.LAST], main[tree.BOLD], main[tree.LEAD], main[tree.REF]) == (0, 14, 4, 4, "p")
    assert page.elements[10][tree.REF] == "p" and page.elements[9][tree.REF] is None and "no" not in page.pieces
    for odd in ("", "</p></div>", "<td>x", "<tr><td>x</table>", "<p", "&amp;&#x1F642;", "<br/><hr>", "<table><table><tr><td>in</table>"):
        page = parsed(odd)
        assert all(i <= e[tree.LAST] < len(page.elements) and e[tree.AT] <= e[tree.END] <= len(page.pieces) for i, e in enumerate(page.elements))


def test_tree_ranges_hold_descendants():
    rng = random.Random(1)
    for _ in range(50):
        html = "".join(rng.choice(["<div>", "</div>", "<p>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "<th>", "</table>", "<b>", "</b>", "<br>", "x ", "<nav>", "</nav>"]) for _ in range(60))
        elements = parsed(html).elements
        for i, e in enumerate(elements):
            inside = [j for j in range(len(elements)) if i in ancestors(elements, j)]
            assert inside == list(range(i + 1, e[tree.LAST] + 1))


def ancestors(elements, i):
    found = []
    while (i := elements[i][tree.PARENT]) >= 0:
        found.append(i)
    return found


STATUS = f"""<html><body><nav><table><tr><th>Summary</th><th>Status</th></tr><tr><td>menu</td><td>Confirmed</td></tr></table></nav><main id="main"><h1>Status</h1>
<table><thead><tr><th>Summary</th><th>Originating update</th><th>Status</th><th>Last updated</th></tr></thead>
<tr><td><b>Secure channel might break</b><br>Domain controllers lose trust.<br><a href="#4990msgdesc">See details</a></td><td>OS Build 26100.9445<br>KB5124008<br>2026-09-08</td><td>Confirmed<br></td><td>2026-09-25<br>13:00 PT</td></tr>
<tr><td><strong>No sound from USB devices</strong><a href="#4984msgdesc">See details</a></td><td>N/A</td><td>Mitigated External</td><td>2026-09-20 10:00 PT</td></tr>
<tr><td><b>File shares vanish</b><a href="#late">x</a></td><td>KB5124008</td><td>Resolved KB5129195</td><td>2026-09-21 10:00 PT</td></tr>
<tr><td>One cell only</td></tr></table>
<h2>Issue details</h2><h3>September 2026</h3>
<div><div id="4990msgdesc"></div><p><b>Secure channel might break</b></p><table><tr><th>Status</th><th>Originating update</th><th>History</th></tr>
<tr><td>Confirmed</td><td>KB5124008</td><td>Last updated: 2026-09-25, 13:00 PT<br>Opened: 2026-09-22, 18:08 PT</td></tr></table>
<p>After the update, domain controllers reject logons. A resolution is expected.</p><p><b>Workaround:</b> Use the registry, not the printer.</p>
<p>Important: This section contains steps for modifying the registry. See how to back up and restore the registry.</p>
<div><p><b>Affected platforms:</b></p><ul><li>Client: Windows 11, version 25H2</li><li>Server: None</li></ul>
<a name="4984msgdesc"></a><p>No sound from USB devices</p><p>Originating update: KB5120000</p><p>{"The device shows an error and plays nothing. " * 4}</p><p>Resolution: It is partially resolved in KB5129195. The rest is resolved in KB5120000 and KB5130000. KIR is available.</p><p>Opened: September 3, 2026</p></div></div>
<h2 id="late">File shares vanish</h2><p>Shares are gone. Resolution: Fixed in KB5129195 and KB5124008.</p>
<h3 id="4777msgdesc">Printing stops</h3><p>Status: Investigating</p><p>The spooler does not start.</p></main></body></html>"""


def test_status_page(spark):
    pages = spark.createDataFrame([("p", STATUS), ("q", None), ("r", ""), ("s", "<table><tr><td>Summary</td><td>Status</td></tr><tr><td>Disk is slow</td><td>Reported</td></tr></table>")], "page_id string, html string")
    found = status_pages.read(tree.trees(pages))
    issues = status_pages.status_issues(found)
    rows = {(r["page_id"], r["issue_id"]): r for r in issues.collect()}
    assert set(rows) == {("p", "4990"), ("p", "4984"), ("p", "late"), ("p", "4777"), ("s", "t-disk-is-slow")}
    trust, audio, shares, printing, disk = (rows[k] for k in (("p", "4990"), ("p", "4984"), ("p", "late"), ("p", "4777"), ("s", "t-disk-is-slow")))
    assert (trust["title"], trust["status"], trust["originating_kbs"], trust["originating_builds"], trust["resolving_kbs"]) == ("Secure channel might break", "confirmed", ["5124008"], ["26100.9445"], [])
    assert trust["workaround"] == "Use the registry, not the printer." and trust["platforms"] == {"client": "Windows 11, version 25H2"} and trust["products"] == ["win11-25h2"]
    assert trust["opened"] == datetime.datetime(2026, 9, 23, 1, 8) and trust["last_updated"] == trust["updated"] == datetime.datetime(2026, 9, 25, 20)
    assert "dc" in trust["tags"] and "printing" not in trust["tags"] and not trust["rollback"]
    assert (audio["status"], audio["originating_kbs"], audio["resolving_kbs"], audio["partial_fix_kbs"], audio["rollback"]) == ("mitigated_external", ["5120000"], ["5130000"], ["5129195"], True)
    assert audio["opened"] == datetime.datetime(2026, 9, 3) and audio["tags"] == ["audio"] and audio["platforms"] == {}
    assert (shares["status"], shares["resolving_kbs"], shares["originating_kbs"], shares["anchor"]) == ("resolved", ["5129195"], ["5124008"], "late")
    assert (printing["title"], printing["status"], printing["updated"], printing["detailed"]) == ("Printing stops", "investigating", None, True)
    assert (disk["status"], disk["detailed"], disk["body"]) == ("investigating", False, "")
    ok = {r["page_id"]: (r["tables"], r["issues"], r["structure_ok"]) for r in status_pages.structure(found, issues).collect()}
    assert ok == {"p": (1, 4, True), "q": (0, 0, False), "r": (0, 0, False), "s": (1, 1, True)}
    assert status_pages.status_issues(status_pages.read(tree.trees(pages.limit(0)))).count() == 0


def article(known, before=""):
    return f"<body><article><h1>Update</h1>{before}<div><h2 id=ki>Known issues in this update</h2>{known}<h2>Other</h2><details><summary>No</summary><p>KB1234567</p></details></div></article></body>"


def test_articles(spark):
    details = (
        "<p>See below.</p><details><summary>Trust with the domain is lost</summary><div><p>After installing KB5124008 or later updates, logons fail.</p></div><p><b>Workaround:</b></p><p>Wait a day.</p><p>Important: This section contains steps for modifying the registry. x</p></details>"
        "<section><details><summary>USB sound</summary><p>No sound.</p><p><strong>Resolution</strong></p><p>It is partially resolved in KB5129195.</p><details><summary>Inner</summary><p>More</p></details></details></section>"
        "<details><summary></summary><p>No title</p></details>"
    )
    table = "<table><tr><th>Symptom</th><th>Resolution</th></tr><tr><td><p><strong>Shares vanish</strong></p><p>They are gone.</p></td><td>Wait. This was fixed in KB5129195.</td></tr></table>"
    third = "<p>Lead.</p><p><strong>Workaround</strong></p><h4>VPN ends</h4><p>Workaround: dial. Resolution: It has been resolved in KB5000002. Partially resolved in KB5000003.</p><h5>Empty</h5>"
    kbs = {
        1: article(details), 2: article(table), 3: article(third), 4: article("<p>Devices are slow after KB5000009. It is fixed in KB5000010.</p>"), 5: article("<p>We are not currently aware of any issues.</p>"), 6: "<p>No section</p>", 7: None,
        8: article("<p>No known issues" + " and so on" * 50 + "</p>"), 9: "<h3>Known issues</h3><h3>Not one</h3><p>x</p>", 10: article("   "),
    }
    pages = spark.createDataFrame([(i, str(5000100 + i), h) for i, h in kbs.items()], "page_id long, kb string, html string")
    rows = articles.article_issues(articles.read(tree.trees(pages, keep=["kb"]))).orderBy("page_id", "place").collect()
    assert [(r["page_id"], r["layout"], r["title"], r["status"]) for r in rows] == [
        (1, "details", "Trust with the domain is lost", "confirmed"), (1, "details", "USB sound", "mitigated"), (1, "details", "Inner", "confirmed"), (2, "table", "Shares vanish", "confirmed"),
        (3, "headings", "VPN ends", "resolved"), (4, "whole", "KB5000104 bilinen sorun", "resolved"), (8, "whole", "KB5000108 bilinen sorun", "confirmed"),
    ]
    trust, sound, inner, shares, vpn, slow, _ = rows
    assert (trust["originating_kbs"], trust["workaround"], trust["anchor"], trust["kb"]) == (["5124008"], "Wait a day.", "ki", "5000101")
    assert (sound["originating_kbs"], sound["resolving_kbs"], sound["partial_fix_kbs"], sound["tags"]) == (["5000101"], [], ["5129195"], ["audio"])
    assert inner["body"] == "More" and (shares["workaround"], shares["resolving_kbs"]) == ("Wait. This was fixed in KB5129195.", [])
    assert vpn["workaround"].startswith("dial.") and (vpn["originating_kbs"], vpn["resolving_kbs"]) == (["5000002", "5000003"], [])
    assert (slow["originating_kbs"], slow["resolving_kbs"], slow["tags"]) == (["5000009", "5000010"], [], ["performance"])


def sections_by_hand(md):
    lines, heads, fenced = md.split("\n"), [], False
    for i, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and line.startswith("#") and line.lstrip("#").startswith(" ") and len(line) - len(line.lstrip("#")) <= 6 and line.lstrip("#").strip():
            heads.append((i, len(line) - len(line.lstrip("#"))))
    out = []
    for j, (i, level) in enumerate(heads):
        below = next((k for k in range(j + 1, len(heads)) if heads[k][1] <= level), None)
        end = heads[j + 1][0] if j + 1 < len(heads) else len(lines)
        whole = len(lines) if below is None else heads[below][0]
        out.append((j + 1, level, "\n".join(lines[i + 1 : end]).strip(" "), "\n".join(lines[i + 1 : whole]).strip(" "), None if below is None else below + 1))
    return out


def test_sections_at_random(spark):
    rng = random.Random(3)
    docs = ["\n".join(rng.choice(["# A", "## B c", "### C ###", "#D", "```", " ```x", "text", "", "####### no", "###### six", "#  ", "a # b"]) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "id string, md string")
    got = {}
    for r in markdown.heading_sections(df, "id", "md").collect():
        got.setdefault(r["id"], []).append((r["section"], r["level"], r["body"], r["whole"], r["ends"]))
    for i, d in enumerate(docs):
        assert got.get(str(i), []) == sections_by_hand(d or "")


def test_sections_of_a_long_document():
    """100,000 lines, a heading every ten, in seconds; a quadratic version takes hours."""
    md = "\n".join(f"{'#' * (i % 3 + 2)} H{i}" if i % 10 == 0 else f"line {i}" for i in range(100_000))
    began = time.time()
    rows = list(markdown.sections_of(md))
    assert len(rows) == 10_000 and time.time() - began < 5
    assert rows[0][3] == "\n".join(f"line {i}" for i in range(1, 10))


def test_text_between_is_linear(spark):
    """A page of many sections is cut in one go."""
    html = "<main>" + "".join(f'<div id="{1000 + i}msgdesc"></div><p>Issue {i} is slow.</p>' for i in range(3000)) + "</main>"
    found = tree.trees(spark.createDataFrame([(1, html)], "page_id long, html string"))
    began = time.time()
    assert status_pages.sections(status_pages.read(found), "page_id").where(F.contains("body", F.lit("is slow"))).count() == 3000
    assert time.time() - began < 60
    assert found.select(text.norm_space(tree.text_of(F.lit(2)))).first()[0] == "Issue 0 is slow."


def test_few_trees_are_held_at_once(spark, monkeypatch):
    """A task gives on the trees of its pages as soon as they tell some number of characters, and none is lost or told twice."""
    import weakref

    monkeypatch.setattr(tree, "HELD_CHARS", 1000, raising=False)
    held, most, make = weakref.WeakSet(), [0], tree.Tree

    class Counted(make):
        def __init__(self):
            super().__init__()
            held.add(self)
            most[0] = max(most[0], len(held))

    monkeypatch.setattr(tree, "Tree", Counted)
    pages = spark.createDataFrame([(i, None if i % 50 == 0 else f"<main><p>{'x' * 200}{i}</p></main>", i % 3) for i in range(400)], "page_id long, html string, k long")
    taken = {}
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, run, kinds: taken.update(run=run))
    tree.trees(pages, keep=["k"])
    batch = pa.RecordBatch.from_pylist([{"html": r["html"], "page_id": r["page_id"], "k": r["k"]} for r in pages.collect()])
    got = [row for part in taken["run"](iter([batch])) for row in part.select(["page_id", "k", "pieces"]).to_pylist()]
    assert [(r["page_id"], r["k"]) for r in got] == [(i, i % 3) for i in range(400)]
    assert all(bool(r["pieces"]) == (r["page_id"] % 50 != 0) for r in got)
    assert most[0] <= 20

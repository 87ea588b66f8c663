"""Operators against row-at-a-time versions on random rows, and the scenarios they are for."""

import random

from pyspark.sql import functions as F

from dawnline.operators import changes, folding, linking, ordered, similarity, tables
from dawnline.operators.graph import components
from dawnline.sources import feeds, html, markdown


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: x for n, x in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_components_of_long_chains(spark):
    """Chains of 1,000 nodes in which the smallest one has far to go: descending after it, and in random orders."""
    n, chains = 1000, [[0, *range(999, 0, -1)]]
    for seed in range(3):
        chains.append(random.Random(seed).sample(range(n), n))
    edges = [(1000 * i + a, 1000 * i + b) for i, c in enumerate(chains) for a, b in zip(c, c[1:], strict=False)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == n * len(chains) and all(r["label"] == r["node"] // n * n for r in got)


def test_set_pairs_lose_nothing(spark):
    rng = random.Random(2)
    base = [rng.sample(range(40), rng.randrange(1, 12)) for _ in range(30)]
    sets = {i: set(s) | ({rng.randrange(40)} if rng.random() < 0.5 else set()) for i, s in enumerate(base * 2)}
    want = set()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (both / len(sets[a] | sets[b]) >= 0.6 or both / min(len(sets[a]), len(sets[b])) >= 0.8):
                want.add((a, b))
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<long>")
    assert {(r["a"], r["b"]) for r in similarity.near_duplicate_pairs(df).collect()} == want


def test_capture_twice_changes_nothing(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (1, None, 1)], "k long, v string, n long")
    first = changes.capture(current, batch, ["k"], ["v"], [F.col("n")])
    assert {r["k"]: (r["change"], r["v"]) for r in first.collect()} == {1: ("unchanged", "a"), 2: ("changed", "c"), 3: ("inserted", "e")}
    again = changes.capture(first.select("k", "v"), batch, ["k"], ["v"], [F.col("n")])
    assert {r["change"] for r in again.collect()} == {"unchanged"}


def test_independent_sources(spark):
    rows = [(1, 1, "a.com", True, None, ""), (1, 2, "a.com", True, None, ""), (1, 3, "b.com", False, "x", ""), (1, 4, "b.com", False, "y", ""), (1, 5, "c.org", False, None, "seen (via www.d.net)"), (1, 6, "d.net", False, None, "")]
    items = spark.createDataFrame(rows, "event long, id long, domain string, press boolean, author string, told string")
    near = spark.createDataFrame([], "a long, b long")
    assert similarity.independent_sources(items.drop("told"), near).first()["independent"] == 5
    assert similarity.independent_sources(items, near).first()["independent"] == 4


def test_versions_compare_with_the_last_version(spark):
    """Against a row-at-a-time fold, with keys that go over batches; small changes add up."""
    rng = random.Random(4)
    rows = [(rng.randrange(4), i, rng.choice("ab"), rng.randrange(30)) for i in range(600)]
    want, last = [], {}
    for k, t, kind, x in rows:
        if k not in last or kind != last[k][0] or abs(x - last[k][1]) >= 12:
            last[k] = (kind, x, last.get(k, (0, 0, 0))[2] + 1)
            want.append((k, t, last[k][2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    history = spark.createDataFrame(rows, "k long, t long, kind string, x long")
    got = folding.emitted(history.repartition(5), "k", ["t"], ["kind", "x"], lambda a, b: a[0] != b[0] or abs(a[1] - b[1]) >= 12)
    assert sorted((r["k"], r["t"], r["version"]) for r in got.collect()) == sorted(want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folding.emitted(history.limit(0), "k", ["t"], ["kind", "x"], lambda a, b: a != b).count() == 0


def test_places_and_predecessors_over_ranges(spark):
    """Against sorted lists, with parts that go over several ranges."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "part string, at long, id long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    order = [F.col("at"), F.col("id")]
    placed = {r["id"]: r["place"] for r in ordered.placed(df, ["part"], order).collect()}
    before = {r["id"]: (r["previous_at"], r["previous_id"]) for r in ordered.with_previous(df, ["part"], order, ["at", "id"]).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for part in ("a", "b", None):
        mine = sorted((at, i) for p, at, i in rows if p == part)
        assert [placed[i] for _, i in mine] == list(range(1, len(mine) + 1))
        assert [before[i] for _, i in mine] == [(None, None), *mine[:-1]]


def test_current_state_survives_a_half_written_version(spark, tmp_path):
    state = tables.CurrentState(spark, f"file://{tmp_path}/s", ["k"], ["v"])
    batch = lambda *rows: spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k long, v string, n long")
    assert state.read() is None
    state.upsert(batch((1, "a"), (2, "b"), (1, "late")), [F.col("n")])
    spark.range(3).write.parquet(f"file://{tmp_path}/s/state-000002")  # a job that died before its version was listed
    assert {(r["k"], r["v"]) for r in state.read().collect()} == {(1, "a"), (2, "b")}
    assert {r["k"]: r["change"] for r in state.upsert(batch((2, "c"), (3, "d")), [F.col("n")]).collect()} == {1: "absent", 2: "changed", 3: "inserted"}
    assert {(r["k"], r["v"]) for r in state.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_half_written_slots_are_written_again(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, slot string")
    rows.where("id = 1").write.partitionBy("slot").parquet(f"{root}/rows")  # part of a slot, not listed as done
    for _ in range(2):
        tables.write_slots(rows, root, "slot")
    assert sorted((r["id"], r["slot"]) for r in spark.read.parquet(f"{root}/rows").collect()) == [(1, "x"), (2, "x"), (3, "y")]


def issues(spark, rows, **given):
    """Records or events of (id, title words, tags, kbs) with what is given for all, at one time."""
    names = {"official": False, "health": False, "article": False, "confirmed": False, "fix_kbs": [], "official_titles": []} | given
    df = spark.createDataFrame([(i, t.split(), t.split(), g, k, []) for i, t, g, k in rows], "id long, title array<string>, tokens array<string>, tags array<string>, kbs array<string>, products array<string>")
    kinds = {"fix_kbs": "array<string>", "official_titles": "array<array<string>>"}
    lits = {n: (F.array(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for x in v)).cast(kinds[n]) if n in kinds else F.lit(v)) for n, v in names.items()}
    return df.withColumns({"at": F.lit("2026-09-01 00:00:00").cast("timestamp"), **lits})


def test_issue_links(spark):
    """Two issues under one update stay apart; a report goes to the one of its symptom."""
    events = issues(spark, [(1, "smart card login", ["auth"], ["5000001"]), (2, "remot deskt black", ["rds"], ["5000001"])])
    reports = issues(spark, [(10, "black deskt after", ["rds"], ["5000001"]), (11, "nothi else", ["audio"], [])])
    assert [(r["id"], r["event"], r["method"]) for r in linking.issue_links(reports, events).collect()] == [(10, 2, "kb+tag")]


def test_official_issue_links(spark):
    """One official title under two updates is one issue; status pages keep different ids apart; unlike official titles stay apart."""
    same = issues(spark, [(1, "wsus fails sync after updat", ["update_install"], ["5000001"])], confirmed=True, official_titles=["wsus fails sync after updat".split()])
    record = issues(spark, [(10, "wsus fails sync after updat", ["update_install"], ["5000002"])], official=True)
    assert [(r["event"], r["method"], r["score"], r["merged"]) for r in linking.issue_links(record, same).collect()] == [(1, "same-official-title", 0.9, None)]
    page = record.withColumn("health", F.lit(True))
    assert linking.issue_links(page, same.withColumn("health", F.lit(True))).count() == 0
    unlike = issues(spark, [(1, "print spool stops", ["vpn"], ["5000002"])], confirmed=True)
    assert linking.issue_links(issues(spark, [(10, "tunne drops early", ["vpn"], ["5000002"])], official=True), unlike).count() == 0
    # a report of the same kind is no official pair, so update and symptom are enough
    assert linking.issue_links(issues(spark, [(10, "tunne drops early", ["vpn"], ["5000002"])]), unlike).first()["method"] == "kb+tag"


def test_fix_bridge_merges_events(spark):
    """A record of an update's page with one event's title, whose update fixes another: the two are one, and chains lead to their end."""
    one = issues(spark, [(3, "remot deskt black", ["rds"], ["5000009"])], confirmed=True, official_titles=["remot deskt black".split()])
    other = issues(spark, [(2, "remot deskt slow black sessi", ["rds"], ["5000001"])], confirmed=True, fix_kbs=["5000005"])
    record = issues(spark, [(10, "remot deskt black", ["rds"], ["5000005"])], official=True, article=True)
    links = linking.issue_links(record, one.unionByName(other))
    assert [(r["event"], r["method"], r["merged"]) for r in links.collect()] == [(2, "fixkb+tag", 3)]
    more = links.select("event", "merged").union(spark.createDataFrame([(3, 7), (2, None)], "event long, merged long"))
    assert {(r["event"], r["into"]) for r in linking.merged_events(more).collect()} == {(3, 2), (7, 2)}


def test_news_pairs_are_all_pairs(spark):
    """Against a comparison of all items with all, within the hours."""
    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(14)], []
    for i in range(70):
        title, begun = rng.sample(words, rng.randrange(1, 6)), rng.sample(words, rng.randrange(2, 9))
        keys = rng.sample(["Van", "12", "Izmir"], rng.randrange(0, 3))
        alt = rng.sample(words, 3) if rng.random() < 0.4 else None
        rows.append((i, rng.randrange(120), title, begun, keys, [" ".join(begun[j : j + 2]) for j in range(len(begun) - 1)], alt, ["A"] if alt and rng.random() < 0.5 else [] if alt else None))
    df = spark.createDataFrame(rows, "id long, h long, title_tokens array<string>, text_tokens array<string>, keys array<string>, shingles array<string>, alt_tokens array<string>, alt_keys array<string>")
    got = {(r["a"], r["b"]): r["score"] for r in linking.news_pairs(df.withColumn("at", F.timestamp_seconds(F.col("h") * 3600))).collect()}

    def share(a, b):
        a, b = set(a), set(b)
        return (len(a & b) / len(a | b), len(a & b) / min(len(a), len(b))) if a and b else (0.0, 0.0)

    def similar(a, b):
        j, c = share(a, b)
        return max(j, 0.85 * c if min(len(a), len(b)) >= 3 else 0.0)

    wanted = 0
    for a in rows:
        for b in rows:
            if a[0] >= b[0] or abs(a[1] - b[1]) > 48:
                continue
            score = max(similar(a[2], b[2]), 0.95 * similar(a[3], b[3]), similar(a[6], b[6]) if a[6] and b[6] else 0.0)
            j, c = share(a[5], b[5])
            if j >= 0.6 or c >= 0.8:
                score = max(score, 0.9)
            x, y = (a[7] or a[4], b[7] or b[4]) if a[6] and b[6] else (a[4], b[4])
            if x and y and not set(x) & set(y) and score < 0.8:
                score = 0.0
            if score >= 0.5:
                wanted += 1
                assert abs(got[a[0], b[0]] - score) < 1e-9
            else:
                assert got.get((a[0], b[0]), 0.0) < 0.5
    assert wanted > 50


def test_html_page():
    title, text, updated, links, cells = html.parse(
        '<title>T x</title><meta name="ms.date" content="2026-01-02"><nav><a href="/n">nav</a></nav><p>one<br>two</p><ul><li>b</li></ul>'
        '<table><tr><th>H</th><th>I</th></tr><tr><td>1</td><td>2</td></tr></table><script>x</script>',
        "https://a.org/p",
    )
    assert (title, updated, links) == ("T x", "2026-01-02", [("https://a.org/n", "nav")])
    assert text.split("\n")[:3] == ["one", "two", "• b"] and "x" not in text.split("\n")
    assert cells == [(0, 0, 0, True, "H"), (0, 0, 1, True, "I"), (0, 1, 0, False, "1"), (0, 1, 1, False, "2")]
    assert html.parse(None, None)[1] == ""


def test_markdown(spark):
    md = "---\ntitle: A b\n---\n# One\ntext\n```\n# no\n```\n## Two\nmore\n# Three\n| a | b |\n|---|---|\n| 1 | 2 |"
    df = spark.createDataFrame([(1, md)], "id long, md string").select("id", markdown.front_matter(F.col("md")).alias("f")).select("id", "f.meta", F.col("f.body").alias("md"))
    assert df.first()["meta"] == {"title": "A b"}
    got = markdown.heading_sections(df, "id", "md").orderBy("section").collect()
    assert [(r["level"], r["title"], r["ends"]) for r in got] == [(1, "One", 3), (2, "Two", 3), (1, "Three", None)]
    assert (got[0]["body"], got[0]["whole"]) == ("text\n```\n# no\n```", "text\n```\n# no\n```\n## Two\nmore")
    assert df.select(markdown.applies_to(F.lit("x\n> **Applies to:**\n> - Windows\n> - [iOS](u)\n\ny - z"))).first()[0] == ["Windows", "iOS"]
    assert df.select(markdown.table_rows(F.col("md"))).first()[0] == [["a", "b"], ["1", "2"]]


def test_feed_file(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<rss><channel><item><title> A  b </title><link>https://a.org/x?utm_source=f</link><description>&lt;p&gt;hi&lt;/p&gt;</description></item><item><title></title></item></channel></rss>')
    items = feeds.read_feed(spark, str(tmp_path / "f.xml")).withColumns({"source": F.lit("s"), "t": F.current_timestamp()})
    got = feeds.entries(items, "source", F.col("t"), F.lit("2000-01-01").cast("timestamp")).collect()
    assert [(r["title"], r["link"], r["summary"]) for r in got] == [("A b", "https://a.org/x", "hi")]


def test_atom_file(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed><entry><title>T</title><link rel="self" href="https://a.org/s"/><link href="https://a.org/y"/><id>u1</id><updated>2026-01-02</updated><summary>s</summary><author><name>n</name></author></entry></feed>')
    assert [tuple(r) for r in feeds.read_feed(spark, str(tmp_path / "a.xml")).collect()] == [("T", "https://a.org/y", "u1", "2026-01-02", "s", "n")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_payloads(spark):
    rates = one(spark, feeds.reference_rates(F.lit('<D Tarih="25.09.2026"><Currency CurrencyCode="USD"><Unit>100</Unit><ForexBuying>4100.5</ForexBuying><ForexSelling>x</ForexSelling></Currency><Currency CurrencyCode="JPY"><Unit>1</Unit></Currency></D>')))
    assert [(q["item"], q["unit"], q["buying"], q["selling"]) for q in rates["quotes"]] == [("USDTRY", 100.0, 41.005, None)] and str(rates["data_time"]) == "2026-09-25 12:30:00"
    assert one(spark, feeds.reference_rates(F.lit("<D/>")))["quotes"] == []
    market = one(spark, feeds.market_quotes(F.lit('{"Update_Date": "2026-09-25 10:00:00", "EUR": 3, "eur": {"Alış": "48,25", "Satış": "48,50"}, "x": {"Name": "22 ayar bilezik", "Buying": "4.123,45"}}')))
    assert [tuple(q) for q in market["quotes"]] == [("EURTRY", 48.25, 48.5), ("BILEZIK22", 4123.45, None)] and str(market["data_time"]) == "2026-09-25 07:00:00"
    mapped = one(spark, feeds.mapped_quotes(F.lit('{"t": "now", "a": [{"b": "1,5"}]}'), {"USDTRY": {"buy": "a.0.b"}, "EURTRY": {"buy": "a.7.b"}}, "t"))
    assert (mapped["data_time"], [tuple(q) for q in mapped["quotes"]]) == ("now", [("USDTRY", 1.5, None)])
    seen = one(spark, feeds.forecast(F.lit('{"current": {"time": "2026-09-25T09:30", "temperature_2m": 18.5, "weather_code": 3}, "daily": {"temperature_2m_max": [22.0, 5], "weather_code": [7]}}')))
    assert (str(seen["data_time"]), seen["current"]["temperature"], seen["current"]["description"]) == ("2026-09-25 06:30:00", 18.5, "Kapalı")
    assert (seen["today"]["max"], seen["today"]["min"], seen["today"]["description"]) == (22.0, None, "Bilinmiyor")
    assert one(spark, feeds.forecast(F.lit(None).cast("string")))["today"]["max"] is None

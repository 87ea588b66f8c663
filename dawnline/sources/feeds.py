"""Feeds and payloads: XML items, mapped JSON, rates, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dawnline.functions import fixed, text, urls

ITEM = "title string, link string, guid string, pubDate string, description string, author string"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The items of RSS files and the entries of Atom files at path, in the columns of ITEM."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    atom = read("entry", "title string, link array<struct<_href: string, _rel: string>>, id string, updated string, published string, summary string, content string, author struct<name: string>")
    link = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get("link", F.lit(0)))["_href"]
    entries = atom.select("title", link.alias("link"), F.col("id").alias("guid"), F.coalesce("published", "updated").alias("pubDate"), F.coalesce("summary", "content").alias("description"), F.col("author.name").alias("author"))
    return read("item", ITEM).union(entries)


def entries(items: DataFrame, source: str, at: Column, since: Column, keep: int = 60) -> DataFrame:
    """Feed items (title, link, guid, description) as observations: canonical link, plain summary of 4000 characters, key.

    Items without title or link and those older than since go; of each source the newest keep stay.
    """
    link = urls.canonical(F.col("link"))
    rows = items.withColumns({"title": text.norm_space("title"), "link": link, "at": at}).where((F.col("title") != "") & F.col("link").isNotNull() & (F.col("link") != "") & (F.col("at") >= since))
    order = Window.partitionBy(source).orderBy(F.desc("at"), "link")
    plain = F.substring(text.norm_space(F.regexp_replace("description", "<[^>]*>", " ")), 1, 4000)
    rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")
    return rows.withColumns({"summary": plain, "key": F.concat(F.lit("rss:"), text.short_hash(F.coalesce("guid", "link")))})


def routed(module: Column, full: Column, keep_articles: bool = False) -> Column:
    """The kind of an item: community and press items are reports if in scope and issue-like, else dropped (null)."""
    report = text.looks_like_issue(full)
    other = F.lit("article") if keep_articles else F.lit(None).cast("string")
    return F.when(module.isin("community", "press"), F.when(~text.in_scope(full), None).when(report, "field_report").otherwise(other)).when(module == "news", "article").otherwise("content")


def mapped_json(payload: Column, mapping: dict[str, str]) -> list[Column]:
    """Columns by dotted paths (numbers index arrays), null where a path leads nowhere."""

    def path(dotted: str) -> str:
        return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))

    return [F.get_json_object(payload, path(p)).alias(name) for name, p in mapping.items()]


def mapped_quotes(payload: Column, items: dict[str, dict[str, str]], time: str | None = None) -> Column:
    """struct of data_time (string) and quotes (item, buying, selling) by a mapping of items to paths; quotes without a price are left out."""
    price = lambda spec, side: text.locale_number(mapped_json(payload, {"p": spec[side]})[0]) if spec.get(side) else F.lit(None).cast("double")
    rows = [F.struct(F.lit(item).alias("item"), price(spec, "buy").alias("buying"), price(spec, "sell").alias("selling")) for item, spec in items.items()]
    quotes = F.filter(F.array(*rows), lambda q: q["buying"].isNotNull() | q["selling"].isNotNull())
    at = mapped_json(payload, {"t": time})[0] if time else F.lit(None).cast("string")
    return F.struct(at.alias("data_time"), quotes.alias("quotes"))


def market_quotes(payload: Column, names: dict[str, list[str]] | None = None, zone: str = "Europe/Istanbul") -> Column:
    """struct of data_time (timestamp, UTC) and quotes (item, buying, selling) of a payload that may name its items in several ways.

    An item is what stands under the first of its names that holds an object, else the first object of its last name.
    """
    price = lambda e, a, b: text.locale_number(F.when(F.map_contains_key(e, a), e[a]).otherwise(e[b]))

    def object_of(entry: Column) -> Column:
        of = lambda m: F.struct(entry["key"].alias("key"), m.alias("m"), F.lower(F.coalesce(m["Name"], m["İsim"], F.lit(""))).alias("label"))
        return text.once(F.from_json(entry["value"], "map<string,string>"), of)

    def quote(item: str, keys: list[str], whole: Column, objects: Column) -> Column:
        first = lambda keep: F.get(F.filter(objects, keep), F.lit(0))["m"]
        under = lambda k: F.when(whole[k].startswith("{"), first(lambda o: o["key"] == k))
        of = lambda e: F.when(e.isNotNull(), F.struct(F.lit(item).alias("item"), price(e, "Alış", "Buying").alias("buying"), price(e, "Satış", "Selling").alias("selling")))
        return text.once(F.coalesce(*map(under, keys), first(lambda o: o["label"] == keys[-1].lower())), of)

    def read(whole: Column) -> Column:
        told = F.coalesce(whole["Update_Date"], whole["Update_Date_Time"], F.get_json_object(payload, "$.Meta_Data.Update_Date"))
        at = F.to_utc_timestamp(F.try_to_timestamp(F.substring(told, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")), zone)
        objects = F.transform(F.filter(F.map_entries(whole), lambda e: e["value"].startswith("{")), object_of)
        quotes = text.once(objects, lambda o: F.array_compact(F.array(*(quote(item, keys, whole, o) for item, keys in (names or fixed.MARKET_NAMES).items()))))
        return F.struct(at.alias("data_time"), quotes.alias("quotes"))

    # each object is parsed once, however many names, labels and prices are looked up in it
    return text.once(F.from_json(payload, "map<string,string>"), read)


_RATES = "struct<_Tarih: string, _Date: string, Currency: array<struct<_CurrencyCode: string, _Kod: string, Unit: string, ForexBuying: string, ForexSelling: string, BanknoteBuying: string, BanknoteSelling: string>>>"


def reference_rates(xml: Column, zone: str = "Europe/Istanbul") -> Column:
    """struct of data_time and quotes (item, unit and four prices per one unit) of a rates document; rates are set at 15:30 local time.

    Its date is Tarih (dd.MM.yyyy) or Date (MM/dd/yyyy).
    """
    doc = F.from_xml(xml, _RATES)
    day = F.coalesce(F.try_to_timestamp(doc["_Tarih"], F.lit("dd.MM.yyyy")), F.try_to_timestamp(doc["_Date"], F.lit("MM/dd/yyyy")))
    at = F.to_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(day) + 15 * 3600 + 1800), zone)
    item = F.create_map(*(F.lit(x) for pair in fixed.RATE_ITEMS.items() for x in pair))

    def quote(c: Column) -> Column:
        unit = F.coalesce(F.nullif(text.locale_number(c["Unit"]), F.lit(0.0)), F.lit(1.0))
        prices = [(text.locale_number(c[tag]) / unit).alias(name) for tag, name in (("ForexBuying", "buying"), ("ForexSelling", "selling"), ("BanknoteBuying", "notes_buying"), ("BanknoteSelling", "notes_selling"))]
        return F.struct(item[F.coalesce(c["_CurrencyCode"], c["_Kod"])].alias("item"), unit.alias("unit"), *prices)

    quotes = F.filter(F.transform(F.coalesce(doc["Currency"], F.array().cast("array<struct<_CurrencyCode: string, _Kod: string, Unit: string, ForexBuying: string, ForexSelling: string, BanknoteBuying: string, BanknoteSelling: string>>")), quote), lambda q: q["item"].isNotNull())
    return F.struct(at.alias("data_time"), quotes.alias("quotes"))


_FORECAST = (
    "struct<current: struct<time: string, temperature_2m: double, apparent_temperature: double, precipitation: double, weather_code: int, wind_speed_10m: double>, daily: struct<temperature_2m_max: array<double>, temperature_2m_min: array<double>,"
    " apparent_temperature_max: array<double>, apparent_temperature_min: array<double>, precipitation_sum: array<double>, precipitation_probability_max: array<double>, weather_code: array<int>>>"
)


def forecast(payload: Column, zone: str = "Europe/Istanbul") -> Column:
    """struct of data_time (UTC), current and today (the first day) of a forecast, each with its code in words."""
    doc = F.from_json(payload, _FORECAST)
    words = F.create_map(*(F.lit(x) for pair in fixed.WEATHER.items() for x in pair))
    told = lambda code: F.coalesce(words[code], F.lit(fixed.WEATHER_UNKNOWN))
    now, day = doc["current"], lambda c: F.get(doc["daily"][c], F.lit(0))
    at = F.to_utc_timestamp(F.coalesce(F.try_to_timestamp(now["time"], F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp(now["time"], F.lit("yyyy-MM-dd'T'HH:mm:ss"))), zone)
    current = F.struct(now["temperature_2m"].alias("temperature"), now["apparent_temperature"].alias("apparent"), now["precipitation"].alias("precipitation"), now["weather_code"].alias("code"), told(now["weather_code"]).alias("description"), now["wind_speed_10m"].alias("wind"))
    today = F.struct(
        day("temperature_2m_max").alias("max"), day("temperature_2m_min").alias("min"), day("apparent_temperature_max").alias("apparent_max"), day("apparent_temperature_min").alias("apparent_min"), day("precipitation_sum").alias("precipitation_sum"),
        day("precipitation_probability_max").alias("precipitation_probability"), day("weather_code").alias("code"), told(day("weather_code")).alias("description"),
    )
    return F.struct(at.alias("data_time"), current.alias("current"), today.alias("today"))


def warnings_for(entries: DataFrame, feed: str, order: str, title: str, summary: str, place: Column, look: int = 40, keep: int = 5) -> DataFrame:
    """Of each feed's first entries (look) those that name the place, at most keep: the feature is a short list."""
    first = entries.withColumn("_n", F.row_number().over(Window.partitionBy(feed).orderBy(order))).where(F.col("_n") <= look)
    low = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))
    named = first.where((F.coalesce(place, F.lit("")) == "") | F.contains(low, F.lower(place))).withColumn("_n", F.row_number().over(Window.partitionBy(feed).orderBy(order))).where(F.col("_n") <= keep)
    return named.drop("_n").withColumn("summary", F.substring(F.coalesce(summary, F.lit("")), 1, 300))


def search_reports(results: DataFrame, url: str, title: str, snippet: str) -> DataFrame:
    """Search results as field reports: http links whose title and snippet read like an issue, once per address, marked as snippet only."""
    told = F.concat_ws(" ", title, snippet)
    rows = results.where(urls.is_safe(F.col(url)) & text.looks_like_issue(told))
    rows = rows.withColumns({"canonical_url": urls.canonical(F.col(url)), "kbs": text.kbs(told), "tags": text.symptom_tags(told), "kind": F.lit("field_report"), "snippet_only": F.lit(True)})
    order = Window.partitionBy("canonical_url").orderBy(title, snippet)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").withColumn("key", F.concat(F.lit("web:"), text.short_hash("canonical_url")))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    return primary.unionByName(fallback.join(primary.select(key), key, "left_anti").select(*primary.columns))

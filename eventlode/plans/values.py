"""Queries of scalar functions and of extraction from nested text, each over values that Spark derives from the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlode.functions import dates, names, text as T
from eventlode.plans.book import Book
from eventlode.sources import bind, feeds, nested, pages, sites

BOOK = Book()
TODAY = dt.date(2000, 1, 1)


@BOOK.add("""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN round(o_orderkey::DECIMAL(18, 4) / 100, 2)::DOUBLE END AS units, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_orderkey END::DOUBLE AS free_price,
 ['$', '€', '£', 'CHF '][1 + o_orderkey % 4] || format('{:,}', o_orderkey) AS money, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE round((o_orderkey * 100)::DECIMAL(28, 10) / (o_orderkey + 7), 1) END::DOUBLE AS share FROM orders""", catalog=False)
def f31_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents, free prices, currency signs, percent with a decimal."""
    k, o = F.col("o_orderkey"), bind.table(spark, sf_dir, "orders")
    code = F.get(F.array(*map(F.lit, ["USD", "EUR", "GBP", "CHF"])), (k % 4).cast("int"))
    words = F.when(k % 7 == 0, "Free entry").otherwise(F.concat(F.lit("from $"), k.cast("string")))
    return o.select(k.alias("k"), T.cents(F.when(k % 4 != 0, k).otherwise(F.lit(0))).alias("units"), T.price_or_free(words).alias("free_price"), T.money(k, code).alias("money"), T.percent_1(k, F.when(k % 3 != 0, k + 7).otherwise(F.lit(0))).alias("share"))


@BOOK.add("""
SELECT o_orderkey AS k, CASE WHEN d >= DATE '2000-01-01' THEN d END AS start_date, CASE o_orderkey % 4 WHEN 0 THEN '19:05' WHEN 1 THEN '00:30' WHEN 2 THEN '20:00' ELSE '09:15' END AS start_time, '22:30' AS end_time,
 (d + INTERVAL 1 DAY)::DATE AS range_end, d AS hebrew FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""", catalog=False)
def f19_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade of date forms with times in twelve hours, ranges with ordinals, Hebrew months; dates that are over are null."""
    k, o = F.col("o_orderkey"), bind.table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    d = F.col("d")
    written = F.when(k % 3 == 0, F.concat(F.lit("on "), d.cast("string"))).when(k % 3 == 1, F.date_format(d, "'Sat' MMM d, yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    clock = F.get(F.array(*map(F.lit, ["7:05 PM", "12:30 am", "27:00", "9:15"])), (k % 4).cast("int"))
    found = dates.date_and_times(written, clock, TODAY)
    span = F.concat(F.date_format(d, "MMMM d'th', yyyy"), F.lit(" to "), F.date_format(F.date_add(d, 1), "MMMM d'th', yyyy"))
    month = F.get(F.array(*map(F.lit, dates.HEBREW_MONTHS)), F.month(d) - 1)
    hebrew = dates.hebrew_date(F.concat_ws(" ", F.dayofmonth(d).cast("string"), month, F.year(d).cast("string")), TODAY)
    return o.select(k.alias("k"), found["start_date"].alias("start_date"), found["start_time"].alias("start_time"), found["end_time"].alias("end_time"), dates.date_range(span, TODAY)["end"].alias("range_end"), hebrew.alias("hebrew"))


@BOOK.add("""
SELECT event_id AS k, epoch_ms(ts) AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, (ts + INTERVAL 3 MONTH)::DATE AS later, CASE WHEN month(ts) >= 10 THEN 2 ELSE 1 END AS n_years, CASE WHEN month(ts) >= 7 THEN year(ts) - 1 ELSE year(ts) END AS other_season FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""", catalog=False)
def f20_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO with Z, epoch seconds and milliseconds, months later, seasons."""
    e = bind.table(spark, sf_dir, "events").withColumn("t", F.date_trunc("second", F.col("ts").cast("timestamp")))
    iso = dates.zulu(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    seconds, millis = F.unix_timestamp("t"), F.unix_timestamp("t") * 1000
    back = F.when(F.col("event_id") % 2 == 0, dates.epoch(seconds)).otherwise(dates.epoch(millis))
    y, m = F.year("t"), F.month("t")
    season = dates.season_years(m, y)
    return e.select(
        F.col("event_id").alias("k"), F.unix_millis(back).alias("ms"), F.date_format(iso, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), dates.months_later(F.to_date("t"), 3).alias("later"), F.size(dates.racing_years(m, y)).alias("n_years"),
        F.when(m >= 7, F.get(season, F.lit(1))).otherwise(F.get(season, F.lit(1))).alias("other_season"),
    )


@BOOK.add("""
SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '["' || p_name || '","' || p_type || '"]' END AS as_json, p_type AS second, (p_size % 5) || ',' || (p_size % 5 + 1) || ',' || (p_size % 5 + 2) || ',99' AS numbers,
 CASE WHEN p_partkey % 2 = 0 THEN 'a' || chr(10) || 'NAME: ' || p_name || chr(10) || 'z' ELSE 'a' || chr(10) || 'NAME: ' || p_name END AS filled FROM part""", catalog=False)
def f46_text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as JSON and back, number ranges, a line put into a template."""
    k, n = F.col("p_partkey"), F.col("p_size") % 5
    values = F.when(k % 4 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array("p_name", "p_type"))
    spec = F.concat(n.cast("string"), F.lit("-"), (n + 2).cast("string"), F.lit(", 99 ,x,9-3"))
    template = F.when(k % 2 == 0, "a\nNAME: old\nz").otherwise("a")
    p = bind.table(spark, sf_dir, "part")
    return p.select(k.alias("k"), T.listed_json(values).alias("as_json"), F.get(T.json_list(F.to_json(F.array("p_name", "p_type"))), F.lit(1)).alias("second"), F.array_join(F.transform(T.range_numbers(spec), lambda x: x.cast("string")), ",").alias("numbers"), T.filled_line(template, "NAME:", F.concat(F.lit("NAME: "), F.col("p_name"))).alias("filled"))


@BOOK.add("""
SELECT p_partkey AS k, p_name || ' Trio' AS found_artist, p_name AS split_event, 'The ' || p_brand AS split_artist, p_name AS cleaned, p_partkey % 5 = 0 AS generic, p_name AS first_name, p_type AS home, p_brand AS away FROM part""".replace("p_name || ' Trio' AS found_artist", "p_name AS found_artist"), catalog=False)
def f11_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists in titles, split titles, cleaned artists, generic names, the first of several, sides of a game."""
    k, n, p = F.col("p_partkey"), F.col("p_name"), bind.table(spark, sf_dir, "part")
    both = names.event_and_artist(F.concat(F.lit("The "), F.col("p_brand"), F.lit(" | "), n))
    home, away = T.versus(F.concat(F.col("p_type"), F.lit(" vs. "), F.col("p_brand")))
    return p.select(
        k.alias("k"), names.artist_in_title(F.concat(n, F.lit(" Trio live"))).alias("found_artist"), both["event"].alias("split_event"), both["artist"].alias("split_artist"), names.clean_artist(F.concat(F.lit("[SOLD OUT] "), n, F.lit("  (US Tour)"))).alias("cleaned"),
        names.is_generic(F.when(k % 5 == 0, "Buy Tickets").otherwise(n)).alias("generic"), names.first_artist(F.concat(n, F.lit(" b2b someone"))).alias("first_name"), home.alias("home"), away.alias("away"),
    )


@BOOK.add("""
SELECT c_custkey AS k, 'NATION_' || c_nationkey AS city, c_custkey % 2 = 1 AS is_online, CASE WHEN c_custkey % 2 = 0 THEN 'Land' END AS country, 'Metro' || c_nationkey AS town, strftime(TIMESTAMP '2024-01-15 12:00:00' + INTERVAL 9 HOUR, '%H:%M') AS local_time,
 c_name || ' - ' || c_mktsegment AS title FROM customer""".replace("'NATION_' || c_nationkey AS city", "CASE WHEN c_custkey % 2 = 0 THEN 'NATION_' || c_nationkey END AS city"), catalog=False)
def f32_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities of addresses and of location lines, local times, titles with their artist."""
    k, c = F.col("c_custkey"), bind.table(spark, sf_dir, "customer")
    nation = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    line = names.place_line(F.when(k % 2 == 0, F.concat(nation, F.lit(", Land • In Person"))).otherwise("Online"))
    address = F.concat(F.lit("Arena, Street, 12345 Metro"), F.col("c_nationkey").cast("string"))
    local = names.local_time(F.lit(dt.datetime(2024, 1, 15, 12)).cast("timestamp"), F.lit("Asia/Tokyo"))
    return c.select(k.alias("k"), line["city"].alias("city"), line["is_online"].alias("is_online"), line["country"].alias("country"), names.city_of_address(address).alias("town"), F.date_format(local, "HH:mm").alias("local_time"), names.titled(F.col("c_name"), F.col("c_mktsegment")).alias("title"))


_LD = "'<html><script type=\"application/ld+json\">{\"@graph\": [{\"@type\": \"' || t || '\", \"name\": \"' || p_name || '\", \"startDate\": \"' || d || 'T20:00\", \"offers\": [{\"price\": \"' || p_size || '\", \"priceCurrency\": \"EUR\"}, {\"price\": \"1\", \"availability\": \"SoldOut\"}]}]}</script><script type=\"application/ld+json\">{bad</script></html>'"
_KINDS = ["MusicEvent", "Hackathon", "SaleEvent", "EventSeries", "PublicationEvent"]


@BOOK.add(f"""
WITH s AS (SELECT p_partkey, p_name, p_size, {_KINDS}[1 + p_partkey % 5] AS t, CASE WHEN p_partkey % 3 = 0 THEN '1999-05-01' ELSE '2031-05-01' END AS d FROM part)
SELECT p_partkey AS k, p_name AS name, t AS event_type, p_size::DOUBLE AS price, 'EUR' AS currency FROM s WHERE t NOT IN ('SaleEvent', 'PublicationEvent') AND d > '2000'""", catalog=False)
def x03_ld_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of pages with JSON-LD: wrappers, types, dates that are over, offers; bad blocks are skipped."""
    k, p = F.col("p_partkey"), bind.table(spark, sf_dir, "part")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (k % 5).cast("int"))
    day = F.when(k % 3 == 0, "1999-05-01").otherwise("2031-05-01")
    offers = F.concat(F.lit('"offers": [{"price": "'), F.col("p_size").cast("string"), F.lit('", "priceCurrency": "EUR"}, {"price": "1", "availability": "SoldOut"}]'))
    entity = F.concat(F.lit('{"@type": "'), kind, F.lit('", "name": "'), F.col("p_name"), F.lit('", "startDate": "'), day, F.lit('T20:00", '), offers, F.lit("}"))
    html = F.concat(F.lit('<html><script type="application/ld+json">{"@graph": ['), entity, F.lit(']}</script><script type="application/ld+json">{bad</script></html>'))
    found = pages.ld_events(p.select(k.alias("k"), html.alias("html")), "html", "k", F.lit(TODAY))
    best = pages.cheapest_offer(F.col("event_json"))
    return found.select("k", "name", "event_type", best["price"].alias("price"), best["currency"].alias("currency"))


@BOOK.add("""
SELECT p_partkey AS k, 'c_' || p_partkey || i AS source_id, CASE WHEN i = 1 THEN '09:05' ELSE '20:30' END AS start_time FROM part, range(1, 3) r(i) WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 3 = 0""", catalog=False)
def x09_time_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slots an item, none for every third, which stays as a row without a time."""
    k, p = F.col("p_partkey"), bind.table(spark, sf_dir, "part")
    slots = F.when(k % 3 == 0, "[]").otherwise(F.concat(F.lit('[["'), k.cast("string"), F.lit('1", "9:05", ""], ["'), k.cast("string"), F.lit('2", "20:30"]]')))
    return nested.time_slots(p.select(k.alias("k"), slots.alias("times")), "times", "c_").select("k", "source_id", "start_time")


@BOOK.add("SELECT p_name AS title, p_partkey::VARCHAR AS id, DATE '2031-01-02' AS start_date, '20:00' AS start_time, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE least(p_size, 30) END::DOUBLE AS price FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 7 <> 0", catalog=False)
def x10_show_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shows with an event each: invisible ones and those that are over go, the smallest number of the price list is the price."""
    k, p = F.col("p_partkey"), bind.table(spark, sf_dir, "part")
    prices = F.when(k % 5 == 0, '[{"price": "ask"}]').otherwise(F.concat(F.lit('[{"price": 30}, {"price": '), F.col("p_size").cast("string"), F.lit('}, {"price": "x"}]')))
    event = F.concat(F.lit('{"id": "'), k.cast("string"), F.lit('", "visibility": '), F.when(k % 2 == 0, "true").otherwise("false"), F.lit(', "availability": true, "show_date": "'), F.when(k % 7 == 0, "1999-01-02").otherwise("2031-01-02"), F.lit('", "show_time": "20:00", "pricelist": '), prices, F.lit("}"))
    payload = F.concat(F.lit('[{"title": "'), F.col("p_name"), F.lit('", "events": ['), event, F.lit(']}, {"title": " ", "events": []}]'))
    return nested.show_events(p.select(payload.alias("payload")), "payload", F.lit(TODAY))


@BOOK.add("""
SELECT p_partkey AS k, p_brand || ':national:TV,' || CASE WHEN p_partkey % 2 = 0 THEN 'Extra:away:STREAMING' ELSE 'Extra:national:TV' END AS channels, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS home, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS away FROM part""", catalog=False)
def x11_channels_and_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of two lists, each once; sides by their mark, else by position."""
    k, p = F.col("p_partkey"), bind.table(spark, sf_dir, "part")
    plain = F.concat(F.lit('[{"names": ["'), F.col("p_brand"), F.lit('", ""]}, {"names": ["'), F.col("p_brand"), F.lit('"]}]'))
    rich = F.concat(F.lit('[{"media": {"shortName": "'), F.col("p_brand"), F.lit('"}}, '), F.when(k % 2 == 0, '{"media": {"shortName": "Extra"}, "type": {"shortName": "STREAMING"}, "market": {"type": "Away"}}]').otherwise('{"media": {"shortName": "Extra"}}, {"media": null}]'))
    team = lambda c, mark: F.concat(F.lit('{"team": {"displayName": "'), F.col(c), F.lit('"}'), mark, F.lit("}"))
    marked = k % 3 == 0
    both = nested.sides(F.concat(F.lit("["), team("p_name", F.when(marked, ', "homeAway": "away"').otherwise("")), F.lit(", "), team("p_type", F.when(marked, ', "homeAway": "home"').otherwise("")), F.lit("]")))
    listed = F.array_join(F.transform(nested.channels(plain, rich, F.lit("US")), lambda c: F.concat_ws(":", c["channel"], c["market"], c["type"])), ",")
    return p.select(k.alias("k"), listed.alias("channels"), both["home"].alias("home"), both["away"].alias("away"))


@BOOK.add("SELECT p_partkey AS k, lower(p_name) || ',' || lower(p_type) AS genres FROM part WHERE length(p_type) > 2", catalog=False)
def x17_infobox_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres of an infobox with links, templates and tags."""
    p = bind.table(spark, sf_dir, "part").filter(F.length("p_type") > 2)
    wiki = F.concat(F.lit("{{Infobox\n| name = x\n| genre = {{flat}}[[Page|"), F.col("p_name"), F.lit("]], <b>[["), F.col("p_type"), F.lit("]]</b>, ab\n| years = 1999\n}}"))
    return p.select(F.col("p_partkey").alias("k"), F.array_join(nested.infobox_genres(wiki), ",").alias("genres"))


@BOOK.add("SELECT p_partkey AS k, DATE '2001-03-04' + (p_size::INT) AS near_date, CASE WHEN p_partkey % 2 = 0 THEN 'https://a.example/x/y' ELSE 'https://b.example/p/q/' || p_partkey END AS link, CASE WHEN p_partkey % 3 <> 0 THEN 'https://ok.example/' END AS chosen, CASE WHEN p_partkey % 2 = 0 THEN 'one' ELSE 'two' END AS platform, p_partkey::VARCHAR AS platform_id, 'https://i.example/' || p_partkey AS image, p_name AS place FROM part", catalog=False)
def x22_fields_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date near a match, absolute links, the first fair url, a platform with its id, images and places of several shapes."""
    k, p = F.col("p_partkey"), bind.table(spark, sf_dir, "part")
    ks = k.cast("string")
    html = F.concat(F.repeat(F.lit("x "), 300), F.lit("2009-09-09 "), F.repeat(F.lit("y "), 300), F.date_add(F.lit(dt.date(2001, 3, 4)), F.col("p_size").cast("int")).cast("string"), F.lit(' <a href="/ticket/'), ks, F.lit('">go</a>'))
    link = F.when(k % 2 == 0, nested.absolute(F.lit("https://a.example/x/z?q=1"), F.lit("y"))).otherwise(nested.absolute(F.lit("https://b.example/x"), F.concat(F.lit("/p/q/"), ks)))
    chosen = nested.links_of(F.lit("https://www.junk.example/a"), ["junk.example"], F.lit("https://sub.junk.example/"), F.when(k % 3 != 0, "https://ok.example/"))
    hosted = nested.platform_of(F.concat(F.when(k % 2 == 0, "https://one.example/v/").otherwise("https://two.example/w/"), ks), [("one.example", "one", r"one\.example/v/(\d+)"), ("two.example", "two", r"two\.example/w/(\d+)")])
    url = F.concat(F.lit('"https://i.example/'), ks, F.lit('"'))
    item = F.when(k % 3 == 0, F.concat(F.lit('{"image": '), url)).when(k % 3 == 1, F.concat(F.lit('{"image": ['), url, F.lit("]"))).otherwise(F.concat(F.lit('{"image": {"url": '), url, F.lit("}")))
    item = F.concat(item, F.when(k % 2 == 0, F.concat(F.lit(', "location": {"name": "'), F.col("p_name"), F.lit('"}}'))).otherwise(F.concat(F.lit(', "location": [{"name": "'), F.col("p_name"), F.lit('"}]}'))))
    return p.select(k.alias("k"), nested.date_near(html, r"/ticket/\d+", TODAY).alias("near_date"), link.alias("link"), chosen.alias("chosen"), hosted["platform"].alias("platform"), hosted["platform_id"].alias("platform_id"), nested.image_of(item).alias("image"), nested.location_of(item)["name"].alias("place"))


@BOOK.add("SELECT n_name AS city_name, 'https://' || lower(replace(n_name, '_', '-')) || '.example/events' AS url FROM nation UNION SELECT n_name, 'https://guide.example/' || lower(replace(n_name, '_', '')) FROM nation", catalog=False)
def s24_candidate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bind.table(spark, sf_dir, "nation").select(F.col("n_name").alias("city_name"))
    return nested.candidates(n, ["https://{slug}.example/events", "https://guide.example/{dense}", "https://{slug}.example/events"]).select("city_name", "url")


@BOOK.add("""
SELECT event_type AS section, count(*) AS n, event_type IN ('click', 'view') AS kept FROM (SELECT DISTINCT event_type, event_id FROM events) GROUP BY 1""", catalog=False)
def s14_sitemap_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of sitemaps by section, with whether their prefix is allowed: dropped ones are counted too."""
    e = bind.table(spark, sf_dir, "events")
    xml = F.concat(F.lit("<urlset><url><loc> https://x.example/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"), F.lit(" </loc></url></urlset>"))
    found = feeds.sitemap(e.select(xml.alias("x")), "x", ["/click/", "/view/"])
    return found.groupBy("section", "kept").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("SELECT c_custkey // 10 AS calendar, count(*) AS n, min(c_name) AS first_name FROM customer GROUP BY 1", catalog=False)
def s17_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries read back from calendar texts that hold ten customers each."""
    c = bind.table(spark, sf_dir, "customer")
    entry = F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), F.col("c_custkey").cast("string"), F.lit("\r\nSUMMARY:"), F.left("c_name", F.lit(9)), F.lit("\r\n "), F.expr("substring(c_name, 10)"), F.lit("\r\nDTSTART;TZID=X:20300101T200000\r\nEND:VEVENT"))
    calendars = c.groupBy(F.floor(F.col("c_custkey") / 10).alias("calendar")).agg(F.concat_ws("\r\n", F.array_sort(F.collect_list(entry))).alias("text"))
    found = calendars.select("calendar", F.explode(pages.ics_events(F.col("text"))).alias("e"))
    return found.groupBy("calendar").agg(F.count(F.lit(1)).alias("n"), F.min("e.summary").alias("first_name"))


@BOOK.add("SELECT page_id, coalesce(trim(regexp_replace(lower(html), '\\s+', ' ', 'g')), '') <> '' AS has_text FROM pages", catalog=False)
def c15_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that is the page's own beginning is evident in it; one that is not is evident in empty pages only."""
    from eventlode.operators import validate

    p = bind.table(spark, sf_dir, "pages")
    return p.select("page_id", (validate.evidenced(F.left("html", F.lit(40)), F.col("html")) & ~validate.evidenced(F.lit("☃ no such name"), F.col("html"))).alias("has_text"))


_SITE_SQL = """
SELECT o_orderkey::VARCHAR AS source_id, 'Show ' || o_orderkey AS name, o_orderdate::DATE AS start_date, '20:30' AS start_time, {price} AS price, 'Hall ' || o_custkey AS venue_name, {category} AS category FROM orders WHERE o_orderdate >= DATE '2000-01-01'{more}"""


def _of_site(spark: SparkSession, sf_dir: str, source: str, item: list, wrap: str, days: int | None = None) -> DataFrame:
    o = bind.table(spark, sf_dir, "orders")
    payload = F.concat(F.lit(wrap.split("@")[0]), F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in item]), F.lit(wrap.split("@")[1]))
    rows = sites.site_records(o.select(payload.alias("payload")), source, F.lit(TODAY), days=days)
    return rows.select("source_id", "name", "start_date", "start_time", "price", "venue_name", F.get("raw_categories", F.lit(0)).alias("category"))


@BOOK.add(_SITE_SQL.format(price="(o_orderkey % 90)::DOUBLE", category="CASE WHEN o_orderkey % 2 = 0 THEN 'Music' ELSE 'Art' END", more=""), catalog=False)
def s19_seatgeek(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    item = ['{"id": ', k, ', "title": "Show ', k, '", "datetime_local": "', F.to_date("o_orderdate"), 'T20:30:00", "type": "', F.when(k % 2 == 0, "concert").otherwise("theater"), '", "stats": {"lowest_price": ', k % 90, '}, "venue": {"name": "Hall ', F.col("o_custkey"), '"}}']
    return _of_site(spark, sf_dir, "seatgeek", item, '{"events": [@]}')


@BOOK.add(_SITE_SQL.format(price="CASE WHEN o_orderkey % 90 <> 0 THEN round((o_orderkey % 90)::DECIMAL(18, 4) / 100, 2)::DOUBLE END", category="'Music'", more=""), catalog=False)
def s19_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    item = ['{"id": "', k, '", "name": "Show ', k, '", "dates": {"event_start_date": "', F.to_date("o_orderdate"), 'T20:30:00+00:00"}, "price": {"amount_from": ', k % 90, '}, "venues": [{"name": "Hall ', F.col("o_custkey"), '"}]}']
    return _of_site(spark, sf_dir, "dice", item, '{"data": [@]}')


@BOOK.add(_SITE_SQL.format(price="NULL::DOUBLE", category="NULL::VARCHAR", more=" AND o_orderdate <= DATE '2000-02-15'").replace("o_orderkey::VARCHAR AS source_id", "'bandsintown:' || o_orderkey AS source_id"), catalog=False)
def s19_bandsintown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item a payload; only the next 45 days."""
    k = F.col("o_orderkey")
    item = ['{"id": "', k, '", "lineup": ["Show ', k, '"], "datetime": "', F.to_date("o_orderdate"), 'T20:30:00", "venue": {"name": "Hall ', F.col("o_custkey"), '"}}']
    return _of_site(spark, sf_dir, "bandsintown", item, "@", days=45)


@BOOK.add(_SITE_SQL.format(price="NULL::DOUBLE", category="CASE WHEN o_orderkey % 2 = 0 THEN 'Music' ELSE 'Religious' END", more="").replace(" WHERE o_orderdate >= DATE '2000-01-01'", ""), catalog=False)
def s19_predicthq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This source keeps what is over."""
    k = F.col("o_orderkey")
    item = ['{"id": "', k, '", "title": "Show ', k, '", "start": "', F.to_date("o_orderdate"), 'T20:30:00Z", "category": "', F.when(k % 2 == 0, "concerts").otherwise("religion"), '", "entities": [{"name": "Hall ', F.col("o_custkey"), '"}], "location": [1.5, 2.5]}']
    return _of_site(spark, sf_dir, "predicthq", item, '{"results": [@]}')


@BOOK.add("""
SELECT 'openf1-' || o_orderkey AS source_id, 'Formula 1 - Race ' || o_orderkey || ' of ' || year(o_orderdate) AS name, o_orderdate::DATE AS start_date, NULL::VARCHAR AS start_time, NULL::DOUBLE AS price, 'Hall ' || o_custkey AS venue_name, 'Sports' AS category
FROM orders WHERE o_orderdate::DATE + 3 >= DATE '2000-01-01'""", catalog=False)
def s19_openf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekends end three days after their start."""
    k = F.col("o_orderkey")
    item = ['{"meeting_key": ', k, ', "meeting_name": "Race ', k, " of ", F.year("o_orderdate"), '", "date_start": "', F.to_date("o_orderdate"), 'T10:30:00+00:00", "circuit_short_name": "Hall ', F.col("o_custkey"), '"}']
    return _of_site(spark, sf_dir, "openf1", item, "@")

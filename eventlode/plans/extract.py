"""Extraction, classification and export over pages, documents and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlode.functions import dates, rules
from eventlode.functions import text as T
from eventlode.operators import export
from eventlode.plans.book import Book
from eventlode.plans.search import bound
from eventlode.sources import bind, pages

BOOK = Book()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "pages")


@BOOK.add(r"""
WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), '') AS h FROM pages)
SELECT page_id, nullif(split_part(split_part(t, ' - ', 1), ' | ', 1), '') AS title, h AS heading FROM t""", catalog=False)
def x14_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", pages.title(F.col("html")).alias("title"), pages.heading(F.col("html")).alias("heading"))


@BOOK.add(r"""
WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav\b[^>]*>.*?</nav>', ' ', 'g'), '(?is)<header\b[^>]*>.*?</header>', ' ', 'g') AS h FROM pages),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?is)<footer\b[^>]*>.*?</footer>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g'), '(?is)<svg\b[^>]*>.*?</svg>', ' ', 'g') AS h FROM c)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))[:200000]) AS clean_md5 FROM d""", catalog=False)
def x13_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.md5(pages.clean(F.col("html"))).alias("clean_md5"))


@BOOK.add(r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1), '') AS section,
 list_last(string_split(regexp_replace(url, '/+$', ''), '/')) AS last, regexp_matches(url, '(?i)[?&]page=\d|/page/\d') OR regexp_matches(html, '(?i)rel="next"|[?&]page=\d|/page/\d') AS paginated FROM pages""", catalog=False)
def f36_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", T.bare_host(u).alias("host"), T.first_path_part(u).alias("section"), T.last_segment(u).alias("last"), pages.paginated(F.col("html"), u).alias("paginated"))


@BOOK.add(r"""
WITH u AS (SELECT nullif(regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1), '') AS section FROM pages) SELECT section, count(*) AS n FROM u WHERE section IS NOT NULL GROUP BY 1 ORDER BY n DESC, section LIMIT 5""", catalog=False)
def a19_top_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five commonest first path parts: a report."""
    return _pages(spark, sf_dir).select(T.first_path_part(F.col("url")).alias("section")).filter("section is not null").groupBy("section").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "section").limit(5)


@BOOK.add("SELECT event_id, sha1(scrape_source || '|' || event_id)[:16] AS sha_id, md5(scrape_source || '|' || event_id)[:16] AS md5_id FROM ev")
def f34_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = bind.catalog_events(spark, sf_dir)
    parts = F.col("scrape_source"), F.col("event_id")
    return ev.select("event_id", T.stable_id(*parts).alias("sha_id"), T.stable_id(*parts, digest="md5").alias("md5_id"))


@BOOK.add(r"""
SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^(.{0,60}).*$', '\1') AS head, try_cast(replace(regexp_extract(text, '(\d[\d,]*(?:\.\d{1,2})?)', 1), ',', '') AS DOUBLE) AS first_number FROM documents""", catalog=False)
def f29_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of collapsed texts, and the first number as a price."""
    d = bind.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring(T.collapse_space(F.col("text")), 1, 60).alias("head"), T.price_of(F.col("text")).alias("first_number"))


#: Rules of the derived catalog, in order.
TYPE_RULES = [("ring", "Jewelry"), ("bolt", "Hardware"), (" red ", "Colour"), ("widget", "Gadget")]


@BOOK.add("""
SELECT type_id, CASE WHEN contains(n, 'ring') THEN 'Jewelry' WHEN contains(n, 'bolt') THEN 'Hardware' WHEN contains(n, ' red ') THEN 'Colour' WHEN contains(n, 'widget') THEN 'Gadget' ELSE 'Other' END AS kind FROM (SELECT type_id, ' ' || lower(type_name) || ' ' AS n FROM types)""")
def c02_rule_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.event_types(spark, sf_dir).select("type_id", rules.first_match(F.col("type_name"), TYPE_RULES, "Other").alias("kind"))


@BOOK.add("""
, f AS (SELECT event_id, min(type_id) AS type_id FROM bridge GROUP BY 1),
r AS (SELECT e.event_id, sport, CASE WHEN venue_type = 'BUILDING' THEN 'Hall' END AS venue_default, ' ' || lower(type_name) || ' ' AS n, CASE WHEN artist_name < 'Supplier#000000010' THEN 'Known' END AS performer FROM ev e LEFT JOIN venues USING (venue_id) LEFT JOIN f ON f.event_id = e.event_id LEFT JOIN types t ON t.type_id = f.type_id LEFT JOIN artists a ON a.event_id = e.event_id)
SELECT event_id, coalesce(performer, sport, venue_default, CASE WHEN contains(n, 'ring') THEN 'Jewelry' WHEN contains(n, 'bolt') THEN 'Hardware' WHEN contains(n, ' red ') THEN 'Colour' WHEN contains(n, 'widget') THEN 'Gadget' END) AS event_type FROM r""")
def c01_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priority chain, with performers overriding sport."""
    c = bound(spark, sf_dir)
    first = c.bridge.groupBy("event_id").agg(F.min("type_id").alias("type_id"))
    rows = c.events.join(c.venues, "venue_id", "left").join(first, "event_id", "left").join(c.types, "type_id", "left").join(c.artists, "event_id", "left")
    performer = F.when(F.col("artist_name") < "Supplier#000000010", "Known")
    kind = rules.priority(F.col("sport"), performer, F.when(F.col("venue_type") == "BUILDING", "Hall"), rules.first_match(F.col("type_name"), TYPE_RULES))
    return rows.select("event_id", kind.alias("event_type"))


@BOOK.add("""
SELECT event_id::VARCHAR AS event_id, coalesce(start_date::VARCHAR, '') AS start_date, coalesce(venue_name, '') AS venue_name, coalesce(city_name, '') AS city_name, coalesce(artist_name, '') AS artist_name, coalesce(sport, '') AS sport
FROM ev LEFT JOIN venues USING (venue_id) LEFT JOIN cities USING (city_id) LEFT JOIN artists USING (event_id) WHERE start_date >= DATE '2001-01-01'""")
def k01_event_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir)
    rows = c.events.filter(F.col("start_date") >= F.lit(bind.AS_OF_DATE)).join(c.venues, "venue_id", "left").join(c.cities, "city_id", "left").join(c.artists, "event_id", "left")
    return export.csv_columns(rows, ["event_id", "start_date", "venue_name", "city_name", "artist_name", "sport"])


@BOOK.add(r"""
, r AS (SELECT event_id, start_date, replace(replace(venue_name, ',', '\,'), ';', '\;') AS v, CASE WHEN event_id % 2 = 0 THEN '19:30' END AS t FROM ev JOIN venues USING (venue_id) WHERE start_date >= DATE '2001-01-01')
SELECT event_id, md5(concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || event_id, 'SUMMARY:Event at ' || v, CASE WHEN t IS NULL THEN 'DTSTART;VALUE=DATE:' || strftime(start_date, '%Y%m%d') ELSE 'DTSTART:' || strftime(start_date, '%Y%m%d') || 'T193000' END,
  CASE WHEN t IS NOT NULL THEN 'DTEND:' || strftime(start_date, '%Y%m%d') || 'T213000' END, 'LOCATION:' || v, 'END:VEVENT')) AS entry_md5 FROM r""")
def k03_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar entries of upcoming events; those of even id have a time."""
    c = bound(spark, sf_dir)
    rows = c.events.filter(F.col("start_date") >= F.lit(bind.AS_OF_DATE)).join(c.venues, "venue_id")
    entry = export.ics_entry(F.col("event_id"), F.concat(F.lit("Event at "), F.col("venue_name")), F.col("start_date"), F.when(F.col("event_id") % 2 == 0, "19:30"), F.col("venue_name"))
    return rows.select("event_id", F.md5(entry).alias("entry_md5"))


@BOOK.add("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN start_date + 2 WHEN event_id % 4 = 1 THEN start_date + 1 ELSE start_date END::DATE AS end_date, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '00:30' ELSE '21:05' END AS end_time FROM ev""")
def f27_default_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hours on from a known start, over midnight too; the given end date only without a start."""
    ev = bind.catalog_events(spark, sf_dir)
    m = F.col("event_id") % 4
    time = F.when(m == 0, F.lit(None)).when(m == 1, "22:30").otherwise("19:05")
    date, clock = dates.default_end(F.col("start_date"), time, F.date_add("start_date", 2))
    return ev.select("event_id", date.alias("end_date"), clock.alias("end_time"))

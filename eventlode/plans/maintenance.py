"""Upserts, merges, de-duplication, retention and repair, over tables derived from the driver's."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlode.operators import fuzzy, resolve, upsert
from eventlode.plans.book import Book
from eventlode.plans.search import bound
from eventlode.sources import bind

BOOK = Book()


@BOOK.add("""
, cur AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN price END AS price, scrape_source FROM ev WHERE event_id % 3 <> 0),
d AS (SELECT event_id, price + 1 AS price, 'late' AS scrape_source FROM ev WHERE event_id % 2 = 0)
SELECT coalesce(cur.event_id, d.event_id) AS event_id, CASE WHEN cur.event_id IS NULL THEN d.price WHEN cur.price IS NULL THEN d.price ELSE cur.price END AS price,
 CASE WHEN cur.event_id IS NULL THEN d.scrape_source ELSE cur.scrape_source END AS scrape_source,
 CASE WHEN cur.event_id IS NULL THEN 'inserted' WHEN d.event_id IS NOT NULL AND cur.price IS NULL AND d.price IS NOT NULL THEN 'updated' ELSE 'same' END AS change
FROM cur FULL JOIN d ON cur.event_id = d.event_id""")
def m01_upsert_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the events as current, some without a price; half as a delta that fills prices."""
    ev = bind.catalog_events(spark, sf_dir)
    cur = ev.filter("event_id % 3 <> 0").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("price")).alias("price"), "scrape_source")
    delta = ev.filter("event_id % 2 = 0").select("event_id", (F.col("price") + 1).alias("price"), F.lit("late").alias("scrape_source"))
    return upsert.upsert(cur, delta, ["event_id"], backfill=["price"])


@BOOK.add("""
, cur AS (SELECT event_id, start_date, scrape_source FROM ev WHERE event_id % 3 <> 0), d AS (SELECT event_id, start_date + 1 AS start_date, scrape_source FROM ev WHERE event_id % 2 = 0)
SELECT coalesce(cur.event_id, d.event_id) AS event_id, coalesce(d.start_date, cur.start_date)::DATE AS start_date, coalesce(cur.scrape_source, d.scrape_source) AS scrape_source,
 CASE WHEN cur.event_id IS NULL THEN 'inserted' WHEN d.event_id IS NOT NULL THEN 'updated' ELSE 'same' END AS change FROM cur FULL JOIN d ON cur.event_id = d.event_id""")
def m02_upsert_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = bind.catalog_events(spark, sf_dir)
    cur = ev.filter("event_id % 3 <> 0").select("event_id", "start_date", "scrape_source")
    delta = ev.filter("event_id % 2 = 0").select("event_id", F.date_add("start_date", 1).alias("start_date"), "scrape_source")
    return upsert.upsert(cur, delta, ["event_id"], overwrite=["start_date"])


@BOOK.add("SELECT type_id, type_name, category FROM types WHERE type_id % 4 <> 0 UNION ALL SELECT type_id, type_name, category FROM types WHERE type_id % 4 = 0")
def m04_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bind.event_types(spark, sf_dir)
    return upsert.insert_absent(t.filter("type_id % 4 <> 0"), t.filter("type_id % 2 = 0"), ["type_id"])


@BOOK.add("""
, cur AS (SELECT venue_id, venue_name, city_id FROM venues WHERE venue_id % 2 = 0),
new AS (SELECT venue_name, city_id FROM venues WHERE venue_id % 2 = 1)
SELECT * FROM cur UNION ALL SELECT (SELECT max(venue_id) FROM cur) + row_number() OVER (ORDER BY venue_name, city_id), venue_name, city_id FROM new""")
def m05_find_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New venues get the numbers after the largest, in natural order."""
    v = bind.venues(spark, sf_dir).select("venue_id", "venue_name", "city_id")
    return upsert.find_or_create(v.filter("venue_id % 2 = 0"), v.drop("venue_id"), ["venue_name", "city_id"], "venue_id")


@BOOK.add("""
, l AS (SELECT artist_name, CASE WHEN event_id % 3 = 0 THEN 'https://x.example/' || (event_id % 4) END AS url, event_id FROM artists),
m AS (SELECT artist_name, url, count(*) AS n FROM l WHERE url IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY artist_name ORDER BY n DESC, url) = 1)
SELECT event_id, artist_name, coalesce(l.url, m.url) AS url FROM l LEFT JOIN m USING (artist_name)""")
def m08_propagate_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a link take their artist's commonest one."""
    rows = bind.event_artists(spark, sf_dir).withColumn("url", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("https://x.example/"), (F.col("event_id") % 4).cast("string"))))
    n = rows.filter("url is not null").groupBy("artist_name", "url").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("artist_name").agg(F.min(F.struct((-F.col("n")).alias("o"), "url")).alias("b")).select("artist_name", F.col("b.url").alias("top"))
    return rows.join(best, "artist_name", "left").select("event_id", "artist_name", F.coalesce("url", "top").alias("url"))


@BOOK.add("SELECT event_id, start_date FROM ev WHERE start_date >= DATE '2000-12-25'")
def m11_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.expired(bind.catalog_events(spark, sf_dir), "start_date", F.date_sub(F.lit(bind.AS_OF_DATE), 7)).select("event_id", "start_date")


@BOOK.add("SELECT venue_id FROM venues WHERE venue_id NOT IN (SELECT venue_id FROM ev WHERE NOT (scrape_source = '1-URGENT' AND start_date < DATE '1999-01-01'))")
def m12_orphans_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues left without events by a filtered delete, and those that had none."""
    c = bound(spark, sf_dir)
    gone = (F.col("scrape_source") == "1-URGENT") & (F.col("start_date") < F.lit(dt.date(1999, 1, 1)))
    return c.venues.join(c.events.filter(~gone), "venue_id", "left_anti").select("venue_id")


@BOOK.add("""
SELECT b.event_id, CASE WHEN venue_id = 7 THEN -1 ELSE type_id END AS type_id FROM bridge b JOIN ev USING (event_id) WHERE venue_id <> 7
UNION ALL SELECT event_id, -1 FROM ev WHERE venue_id = 7""")
def m13_replace_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a venue get one type instead of theirs."""
    c = bound(spark, sf_dir)
    own = c.events.filter("venue_id = 7").select("event_id")
    return c.bridge.join(c.events.select("event_id"), "event_id", "left_semi").join(own, "event_id", "left_anti").select("event_id", "type_id").unionByName(own.withColumn("type_id", F.lit(-1).cast("long")))


@BOOK.add("""
SELECT log_id, CASE WHEN log_id % 7 = 0 AND started_at < TIMESTAMP '2024-01-29 22:00' THEN 'stale' WHEN log_id % 7 = 0 THEN 'running' ELSE 'success' END AS status,
 CASE WHEN log_id % 7 = 0 AND started_at < TIMESTAMP '2024-01-29 22:00' THEN ' (stale)' END AS notes FROM logs""")
def m16_stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = bind.scan_logs(spark, sf_dir).withColumn("status", F.when(F.col("log_id") % 7 == 0, "running").otherwise("success")).withColumn("notes", F.lit(None).cast("string"))
    return upsert.stale_runs(runs, F.lit(bind.AS_OF_TS)).select("log_id", "status", "notes")


_MAP = """
, n AS (SELECT venue_id, city_id, venue_type, (SELECT count(*) FROM ev WHERE ev.venue_id = v.venue_id) AS w FROM venues v),
k AS (SELECT venue_id, first_value(venue_id) OVER (PARTITION BY city_id, venue_type ORDER BY w DESC, venue_id) AS keep_id FROM n)"""


@BOOK.add(_MAP + " SELECT venue_id AS drop_id, keep_id FROM k WHERE venue_id <> keep_id")
def w04_canonical_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of venues that share city and kind the one with most events stays."""
    c = bound(spark, sf_dir)
    n = c.events.groupBy("venue_id").agg(F.count(F.lit(1)).alias("w"))
    return resolve.canonical(c.venues.join(n, "venue_id", "left").withColumn("w", F.coalesce("w", F.lit(0))), ["city_id", "venue_type"], "venue_id", "w")


@BOOK.add(_MAP + " SELECT keep_id AS venue_id, count(*) AS n_events FROM ev JOIN k USING (venue_id) GROUP BY 1")
def d06_merge_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per venue after the merge."""
    merged = resolve.repointed(bind.catalog_events(spark, sf_dir), "venue_id", w04_canonical_venues(spark, sf_dir))
    return merged.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n_events"))


@BOOK.add("""
, r AS (SELECT event_id, venue_id, start_date, scrape_source, CASE WHEN event_id % 3 <> 0 THEN price END AS price, CASE WHEN event_id % 2 = 0 THEN sport END AS sport FROM ev),
p AS (SELECT *, CASE scrape_source WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 8 ELSE 1 END AS pr, (price IS NOT NULL)::INT + (sport IS NOT NULL)::INT AS co FROM r),
w AS (SELECT event_id, venue_id, start_date, coalesce(price, first_value(price IGNORE NULLS) OVER all_) AS price, coalesce(sport, first_value(sport IGNORE NULLS) OVER all_) AS sport,
  count(*) OVER (PARTITION BY venue_id, start_date) AS n_members, row_number() OVER (PARTITION BY venue_id, start_date ORDER BY pr DESC, co DESC, event_id) AS k FROM p
  WINDOW all_ AS (PARTITION BY venue_id, start_date ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_id, venue_id, start_date, price, sport, n_members FROM w WHERE k = 1""")
def w02_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best row of each venue and day, blanks filled from the others."""
    ev = bind.catalog_events(spark, sf_dir).withColumn("price", F.when(F.col("event_id") % 3 != 0, F.col("price"))).withColumn("sport", F.when(F.col("event_id") % 2 == 0, F.col("sport")))
    rows = ev.withColumn("cluster", F.struct("venue_id", "start_date"))
    order = F.when(F.col("scrape_source") == "1-URGENT", 10).when(F.col("scrape_source") == "2-HIGH", 8).otherwise(1)
    return resolve.keepers(rows, "cluster", "event_id", order, ["price", "sport"]).select("event_id", "venue_id", "start_date", "price", "sport", "n_members")


@BOOK.add()
def y06_greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of resembling names within venue and day: order matters, so there is no SQL; tests hold it."""
    c = bound(spark, sf_dir)
    first = c.bridge.groupBy("event_id").agg(F.min("type_id").alias("type_id"))
    named = c.events.join(first, "event_id").join(c.types, "type_id").select("event_id", "venue_id", "start_date", "type_name")
    return fuzzy.clustered(named, ["venue_id", "start_date"], "event_id", "type_name")


@BOOK.add("""
, t AS (SELECT lower(type_name) AS k, type_name, type_id FROM types WHERE type_id % 2 = 0 UNION ALL SELECT lower(type_name), upper(type_name), type_id FROM types WHERE type_id % 2 = 1)
SELECT k, min_by(type_name, type_id) AS name FROM t GROUP BY k""")
def u02_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union without case, the spelling of the smallest id kept."""
    t = bind.event_types(spark, sf_dir)
    both = t.filter("type_id % 2 = 0").select("type_name", "type_id").union(t.filter("type_id % 2 = 1").select(F.upper("type_name"), "type_id"))
    return both.groupBy(F.lower("type_name").alias("k")).agg(F.min_by("type_name", "type_id").alias("name"))


@BOOK.add("SELECT event_id FROM (SELECT event_id, list(DISTINCT category) AS c FROM bridge JOIN types USING (type_id) GROUP BY 1) WHERE list_has_any(c, ['PROMO', 'SMALL']) AND NOT list_contains(c, 'LARGE')")
def u05_type_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir)
    sets = c.bridge.join(c.types, "type_id").groupBy("event_id").agg(F.collect_set("category").alias("c"))
    return sets.filter(F.arrays_overlap("c", F.array(F.lit("PROMO"), F.lit("SMALL"))) & ~F.array_contains("c", "LARGE")).select("event_id")


@BOOK.add("""
, a AS (SELECT event_id, price AS left_price FROM ev WHERE event_id % 3 <> 0), b AS (SELECT event_id, price * 2 AS right_price FROM ev WHERE event_id % 2 = 0)
SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(left_price, right_price) AS price FROM a FULL JOIN b ON a.event_id = b.event_id""")
def j15_two_feed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = bind.catalog_events(spark, sf_dir)
    a, b = ev.filter("event_id % 3 <> 0").select("event_id", F.col("price").alias("left_price")), ev.filter("event_id % 2 = 0").select("event_id", (F.col("price") * 2).alias("right_price"))
    return a.join(b, "event_id", "full").select("event_id", F.coalesce("left_price", "right_price").alias("price"))


@BOOK.add("SELECT city_id, (city_id - 7 + 25) % 25 AS place FROM cities WHERE (city_id - 7 + 25) % 25 < 4")
def l09_rotating_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cities from a cursor on, round the end."""
    place = F.pmod(F.col("city_id") - 7, F.lit(25))
    return bind.cities(spark, sf_dir).select("city_id", place.cast("long").alias("place")).filter("place < 4")


@BOOK.add("""
SELECT venue_id, venue_type, row_number() OVER (PARTITION BY venue_type ORDER BY venue_name) AS r FROM venues QUALIFY r <= 3""")
def w06_first_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each kind; the rank limit is applied before the shuffle as well."""
    w = Window.partitionBy("venue_type").orderBy("venue_name")
    return bind.venues(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("venue_id", "venue_type", F.col("r").cast("long").alias("r"))

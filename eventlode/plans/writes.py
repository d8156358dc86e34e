"""Maintenance writes, the duplicates job and exports, over tables that Spark derives from the catalog's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlode.functions import text as T
from eventlode.operators import export, resolve, writes
from eventlode.operators.landed import landed
from eventlode.plans.book import Book
from eventlode.plans.search import bound
from eventlode.sources import bind

BOOK = Book()
_UP = "start_date >= DATE '2001-01-01'"

_WIDE = """
, wide AS (SELECT event_id, event_id AS source_id, scrape_source, start_date, venue_id, event_name AS name, artist_name, home_team, away_team, sport, price,
  CASE WHEN event_id % 3 = 0 THEN '20:00' WHEN event_id % 3 = 1 THEN '23:30' END AS start_time FROM ev LEFT JOIN matches USING (event_id) LEFT JOIN artists USING (event_id))
"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = bind.catalog_events(spark, sf_dir).join(bind.match_ups(spark, sf_dir), "event_id", "left").join(bind.event_artists(spark, sf_dir), "event_id", "left")
    return rows.select("event_id", i.alias("source_id"), "scrape_source", "start_date", "venue_id", F.col("event_name").alias("name"), "artist_name", "home_team", "away_team", "sport", "price", F.when(i % 3 == 0, "20:00").when(i % 3 == 1, "23:30").alias("start_time"))


@BOOK.add(f"""{_WIDE.rstrip()}
, cur AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN price END AS p, CASE WHEN event_id % 7 = 0 THEN NULL ELSE sport END AS sp, CASE WHEN event_id % 9 = 0 THEN '01:00' END AS et, CASE WHEN event_id % 9 = 0 THEN start_date END AS ed FROM wide WHERE event_id % 4 <> 0),
d AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN '22:00' END AS et, CASE WHEN event_id % 10 = 0 THEN start_date + 1 END AS ed FROM wide WHERE event_id % 3 <> 2),
j AS (SELECT coalesce(cur.event_id, d.event_id) AS event_id, cur.event_id IS NOT NULL AS old, d.event_id IS NOT NULL AS new, cur.start_time AS st, cur.start_date AS sd, cur.p, cur.sp, cur.et AS cet, cur.ed AS ced, d.price AS dp, d.sport AS dsp, d.et AS det, d.ed AS ded, cur.home_team AS ch, d.home_team AS dh FROM cur FULL JOIN d USING (event_id))
SELECT event_id, CASE WHEN NOT old THEN dp WHEN new THEN coalesce(p, dp) ELSE p END AS price, CASE WHEN NOT old THEN dsp WHEN new AND dsp IS NOT NULL THEN dsp ELSE sp END AS sport,
 CASE WHEN NOT old THEN det WHEN NOT new OR cet IS NOT NULL THEN cet WHEN det IS NOT NULL THEN det WHEN st = '20:00' THEN '22:00' WHEN st = '23:30' THEN '01:30' END AS end_time,
 CASE WHEN NOT old THEN ded WHEN NOT new OR cet IS NOT NULL THEN ced WHEN det IS NOT NULL THEN coalesce(ded, ced) WHEN st = '20:00' THEN sd WHEN st = '23:30' THEN sd + 1 ELSE ced END::DATE AS end_date,
 CASE WHEN NOT old THEN 'inserted' WHEN new AND (p IS NULL AND dp IS NOT NULL OR dsp IS NOT NULL AND dsp IS DISTINCT FROM sp OR cet IS NULL AND (det IS NOT NULL OR st IS NOT NULL)) THEN 'updated' ELSE 'same' END AS change FROM j""")
def m01_synced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the events as stored, lacking some values, two thirds as they come."""
    i, w = F.col("event_id"), wide(spark, sf_dir)
    none = {"price_currency": F.lit("USD"), "tv_channels": F.lit(None).cast("array<string>"), "artist_youtube_channel": F.lit(None).cast("string")}
    cur = w.filter("event_id % 4 <> 0").withColumns(none | {"price": F.when(i % 2 == 0, F.col("price")), "sport": F.when(i % 7 != 0, F.col("sport")), "end_time": F.when(i % 9 == 0, "01:00"), "end_date": F.when(i % 9 == 0, F.col("start_date"))})
    delta = w.filter("event_id % 3 <> 2").withColumns(none | {"end_time": F.when(i % 5 == 0, "22:00"), "end_date": F.when(i % 10 == 0, F.date_add("start_date", 1))})
    return writes.synced(cur, delta, ["event_id"]).select("event_id", "price", "sport", "end_time", "end_date", "change")


@BOOK.add("""
, cur AS (SELECT event_id, event_id % 2 = 0 AS is_online, venue_id, start_date AS end_date FROM ev WHERE event_id % 3 <> 0), d AS (SELECT event_id, event_id % 4 = 0 AS is_online, venue_id + 1 AS venue_id, start_date + 2 AS end_date FROM ev WHERE event_id % 5 <> 0)
SELECT coalesce(cur.event_id, d.event_id) AS event_id, CASE WHEN cur.event_id IS NULL THEN d.is_online ELSE cur.is_online AND NOT (d.event_id IS NOT NULL AND NOT d.is_online) END AS is_online,
 CASE WHEN cur.event_id IS NULL OR cur.is_online AND NOT d.is_online THEN d.venue_id ELSE cur.venue_id END AS venue_id, CASE WHEN cur.event_id IS NULL OR cur.is_online AND NOT d.is_online THEN d.end_date ELSE cur.end_date END AS end_date FROM cur FULL JOIN d USING (event_id)""")
def m03_online_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, i = bind.catalog_events(spark, sf_dir), F.col("event_id")
    cur = ev.filter("event_id % 3 <> 0").select("event_id", (i % 2 == 0).alias("is_online"), "venue_id", F.lit("v").alias("venue_name"), F.col("start_date").alias("end_date"))
    delta = ev.filter("event_id % 5 <> 0").select("event_id", (i % 4 == 0).alias("is_online"), (F.col("venue_id") + 1).alias("venue_id"), F.lit("w").alias("venue_name"), F.date_add("start_date", 2).alias("end_date"))
    return writes.online_repaired(cur, delta, ["event_id"]).select("event_id", "is_online", "venue_id", "end_date")


@BOOK.add("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN venue_id WHEN event_id % 3 = 0 THEN NULL WHEN city_id = 4 THEN venue_id END AS venue_id FROM ev JOIN venues USING (venue_id)")
def m07_orphans_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the events without an id, a third of these without a name; only one city's venues are known."""
    i, v = F.col("event_id"), bind.venues(spark, sf_dir)
    ev = bind.catalog_events(spark, sf_dir).join(v.select("venue_id", "venue_name"), "venue_id").select("event_id", F.when(i % 2 == 0, F.col("venue_id")).alias("venue_id"), F.when(i % 3 != 0, F.col("venue_name")).alias("venue_name"))
    return writes.orphans_placed(ev, v, 4).select("event_id", "venue_id")


_PEOPLE = """
, people AS (SELECT s_suppkey::BIGINT AS performer_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '["old"]' END AS genres, CASE WHEN s_suppkey % 3 = 0 THEN 'Old Type' END AS event_type_name FROM supplier),
found AS (SELECT s_suppkey::BIGINT AS performer_id, (s_suppkey * 7) % 101 AS popularity, 'https://x.example/' || s_suppkey AS url, CASE WHEN s_suppkey % 4 = 0 THEN '["new"]' END AS genres, CASE WHEN s_suppkey % 5 = 0 THEN 'New Type' END AS event_type_name FROM supplier WHERE s_suppkey % 10 <> 1)
"""


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, none, s = F.col("s_suppkey"), F.lit(None).cast("string"), bind.table(spark, sf_dir, "supplier")
    people = s.select(k.cast("long").alias("performer_id"), F.col("s_name").alias("name"), none.alias("spotify_id"), none.alias("spotify_url"), none.alias("image_url"), F.lit(None).cast("long").alias("popularity"), F.when(k % 2 == 0, '["old"]').alias("genres"), F.when(k % 3 == 0, "Old Type").alias("event_type_name"), none.alias("category"), F.lit("seed").alias("source"))
    found = s.filter("s_suppkey % 10 <> 1").select(k.cast("long").alias("performer_id"), k.cast("string").alias("spotify_id"), F.concat(F.lit("https://x.example/"), k.cast("string")).alias("spotify_url"), none.alias("image_url"), ((k * 7) % 101).cast("long").alias("popularity"), F.when(k % 4 == 0, '["new"]').alias("genres"), F.when(k % 5 == 0, "New Type").alias("event_type_name"), F.lit("Music").alias("category"))
    return people, found


@BOOK.add(f"""{_PEOPLE.rstrip()}
SELECT p.performer_id, f.url AS spotify_url, f.popularity, coalesce(f.genres, p.genres) AS genres, coalesce(f.event_type_name, p.event_type_name) AS event_type_name, CASE WHEN f.event_type_name IS NOT NULL THEN 'spotify' ELSE 'seed' END AS source FROM people p LEFT JOIN found f USING (performer_id)""")
def m09_enriched_performers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.enriched_performers(*_people(spark, sf_dir)).select("performer_id", "spotify_url", "popularity", "genres", "event_type_name", "source")


@BOOK.add(f"""{_PEOPLE.rstrip()}
SELECT event_id, CASE WHEN popularity > 0 THEN greatest(1, round_even(popularity / 10.0, 0))::INT END AS artist_popularity, url AS artist_spotify_url FROM ev LEFT JOIN artists USING (event_id) LEFT JOIN people ON name = artist_name LEFT JOIN found USING (performer_id)""")
def m09_enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = writes.enriched_performers(*_people(spark, sf_dir))
    ev = bind.catalog_events(spark, sf_dir).join(bind.event_artists(spark, sf_dir), "event_id", "left")
    rows = ev.withColumns({"artist_popularity": F.lit(None).cast("int"), "artist_spotify_url": F.lit(None).cast("string"), "image_url": F.lit(None).cast("string")})
    return writes.enriched_events(rows, people).select("event_id", "artist_popularity", "artist_spotify_url")


@BOOK.add("SELECT lower(s_name) AS name_key, CASE WHEN s_suppkey % 2 = 0 THEN 'known' ELSE 'not_found' END AS source FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 <> 0 AND lower(s_name) IN (SELECT lower(artist_name) FROM artists)")
def m10_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even suppliers are known; of the events' artists every third is found; the others get stubs."""
    s, key = bind.table(spark, sf_dir, "supplier"), F.lower("s_name").alias("name_key")
    known = s.filter("s_suppkey % 2 = 0").select(key, F.lit("known").alias("source"))
    asked = bind.event_artists(spark, sf_dir).select(F.lower("artist_name").alias("name_key"))
    return writes.with_stubs(known, asked, s.filter("s_suppkey % 3 = 0").select(key), "name_key", {"source": F.lit("not_found")})


@BOOK.add("""
, cur AS (SELECT * FROM taxonomy WHERE sub_genre < 'NATION_5'), d AS (SELECT sub_genre, CASE WHEN length(sub_genre) = 8 THEN 'World' ELSE parent_genre END AS parent_genre FROM taxonomy WHERE sub_genre > 'NATION_15')
SELECT coalesce(cur.sub_genre, d.sub_genre) AS sub_genre, coalesce(d.parent_genre, cur.parent_genre) AS parent_genre, CASE WHEN cur.sub_genre IS NULL THEN 'inserted' WHEN d.parent_genre <> cur.parent_genre THEN 'updated' ELSE 'same' END AS change FROM cur FULL JOIN d USING (sub_genre)""")
def m14_taxonomy_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a sub-genre that comes twice the first parent wins."""
    t = bind.genre_taxonomy(spark, sf_dir)
    new = t.filter("sub_genre > 'NATION_15'").withColumn("parent_genre", F.when(F.length("sub_genre") == 8, "World").otherwise(F.col("parent_genre")))
    twice = new.withColumn("position", F.lit(1)).unionByName(new.withColumn("parent_genre", F.lit("late")).withColumn("position", F.lit(2)))
    return writes.taxonomy_upsert(t.filter("sub_genre < 'NATION_5'"), twice)


@BOOK.add("""
, cur AS (SELECT normalized_name, primary_genre, secondary_1 FROM genres WHERE normalized_name < 'supplier#000000060'), d AS (SELECT normalized_name, primary_genre, CASE WHEN primary_genre = 'UNKNOWN' THEN 'x' ELSE secondary_1 END AS secondary_1 FROM genres WHERE normalized_name > 'supplier#000000003')
SELECT coalesce(cur.normalized_name, d.normalized_name) AS normalized_name, CASE WHEN d.normalized_name IS NOT NULL THEN d.secondary_1 ELSE cur.secondary_1 END AS secondary_1,
 CASE WHEN cur.normalized_name IS NULL THEN 'new' WHEN d.normalized_name IS NULL THEN 'absent' WHEN cur.primary_genre IS NOT DISTINCT FROM d.primary_genre AND cur.secondary_1 IS NOT DISTINCT FROM d.secondary_1 THEN 'unchanged' ELSE 'changed' END AS status FROM cur FULL JOIN d USING (normalized_name)""")
def m15_classification_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bind.artist_genres(spark, sf_dir)
    delta = g.filter("normalized_name > 'supplier#000000003'").withColumn("secondary_1", F.when(F.col("primary_genre") == "UNKNOWN", "x").otherwise(F.col("secondary_1")))
    return writes.classification_upsert(g.filter("normalized_name < 'supplier#000000060'"), delta, "normalized_name", ["primary_genre", "secondary_1"]).select("normalized_name", "secondary_1", "status")


@BOOK.add("""
, have AS (SELECT * FROM venues WHERE venue_id % 3 <> 0), f AS (SELECT upper(venue_name) AS venue_name, city_id FROM venues),
new AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM have WHERE lower(have.venue_name) = lower(f.venue_name) AND have.city_id = f.city_id))
SELECT venue_id, venue_name, city_id FROM have UNION ALL SELECT (SELECT max(venue_id) FROM have) + row_number() OVER (ORDER BY city_id, venue_name), venue_name, city_id FROM new""")
def m17_discovered_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bind.venues(spark, sf_dir)
    return writes.discovered(v.filter("venue_id % 3 <> 0"), v.select(F.upper("venue_name").alias("venue_name"), "city_id")).select("venue_id", "venue_name", "city_id")


@BOOK.add("SELECT log_id, CASE WHEN log_id = 7 THEN 'failed' WHEN log_id % 2 = 1 THEN 'running' ELSE 'success' END AS status, CASE WHEN log_id = 7 THEN 11 END AS events_saved, CASE WHEN log_id = 7 THEN 'timeout' END AS notes FROM logs")
def m18_run_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = bind.scan_logs(spark, sf_dir).withColumns({"status": F.when(F.col("log_id") % 2 == 1, "running").otherwise("success"), "finished_at": F.lit(None).cast("timestamp_ntz"), "events_saved": F.lit(None).cast("int"), "notes": F.lit(None).cast("string")})
    return writes.run_finished(logs, 7, 20, 11, F.lit(bind.AS_OF_TS).cast("timestamp_ntz"), "timeout").select("log_id", "status", "events_saved", "notes")


@BOOK.add("SELECT lower(s_name) AS normalized_name, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE upper(s_name) END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM supplier")
def m20_uploaded_performers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bind.table(spark, sf_dir, "supplier")
    have = s.filter("s_suppkey % 2 = 0").select(F.lower("s_name").alias("normalized_name"), F.col("s_name").alias("name"), F.lit(0.9).alias("confidence"))
    names = s.select(F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("name")).union(s.select(F.upper("s_name"))).union(s.limit(1).select(F.lit("  ")))
    return writes.performers_uploaded(have, names)


def _lookups(refetch: bool) -> str:
    return f"""
SELECT s_suppkey::BIGINT AS k, CASE WHEN s_suppkey % 2 = 0 AND (s_suppkey % 3 <> 0 OR {not refetch}) THEN 'old' ELSE 'new' END AS v, CASE WHEN s_suppkey % 2 <> 0 THEN 'inserted' WHEN s_suppkey % 3 = 0 AND {refetch} THEN 'updated' ELSE 'same' END AS change FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0"""


def _looked_up(spark: SparkSession, sf_dir: str, refetch: bool) -> DataFrame:
    s, k = bind.table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("long").alias("k")
    return writes.lookups_written(s.filter("s_suppkey % 2 = 0").select(k, F.lit("old").alias("v")), s.filter("s_suppkey % 3 = 0").select(k, F.lit("new").alias("v")), "k", refetch)


@BOOK.add(_lookups(True))
def m23_lookups_refetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir, True)


@BOOK.add(_lookups(False))
def m23_lookups_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir, False)


@BOOK.add(f"""
, s AS (SELECT event_id, venue_id, start_date, lpad(event_id::VARCHAR, 9, '0') AS source_id FROM ev), f AS (SELECT venue_id, min(source_id) AS source_id FROM s WHERE {_UP} GROUP BY 1),
u AS (SELECT source_id, 'https://tag.example/' || source_id AS u1 FROM s WHERE event_id % 3 = 0)
SELECT venue_id, CASE WHEN website_url IS NOT NULL THEN website_url WHEN u1 IS NOT NULL THEN u1 WHEN f.venue_id IS NOT NULL AND venue_id % 2 = 0 THEN 'https://name.example/' || venue_id END AS website_url,
 CASE WHEN website_url IS NOT NULL THEN 0 WHEN u1 IS NOT NULL THEN 1 WHEN f.venue_id IS NOT NULL AND venue_id % 2 = 0 THEN 2 END AS phase FROM venues LEFT JOIN f USING (venue_id) LEFT JOIN u USING (source_id)""")
def m24_venue_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bind.venues(spark, sf_dir)
    ev = bind.catalog_events(spark, sf_dir).withColumn("source_id", F.lpad(F.col("event_id").cast("string"), 9, "0"))
    tags = ev.filter("event_id % 3 = 0").select("source_id", F.concat(F.lit("https://tag.example/"), "source_id").alias("url"))
    names = v.filter("venue_id % 2 = 0").select("venue_name", F.concat(F.lit("https://name.example/"), F.col("venue_id").cast("string")).alias("url"))
    return writes.venue_links(v, ev, tags, names, F.lit(bind.AS_OF_DATE)).select("venue_id", "website_url", "phase")


@BOOK.add("""
SELECT artist_name, count(*) AS n_events FROM ev JOIN artists USING (event_id) WHERE event_id % 3 = 0 GROUP BY 1 ORDER BY n_events DESC, artist_name LIMIT 15""")
def m25_pending_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen artists with most events that nobody looked up, sports rows too; rows marked as looked up don't count. A report, so the limit is the feature."""
    i = F.col("event_id")
    ev = bind.catalog_events(spark, sf_dir).join(bind.event_artists(spark, sf_dir), "event_id").withColumn("artist_youtube_channel", F.when(i % 3 == 1, "").when(i % 3 == 2, "u"))
    return writes.pending_links(ev, 15, sports=True, tried=False)


@BOOK.add("SELECT event_id FROM ev WHERE NOT coalesce(scrape_source = '2-HIGH' AND start_date < DATE '2000-01-01' AND price > 100000, false)")
def p18_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _, _ = writes.deletion(bind.catalog_events(spark, sf_dir), [F.col("scrape_source") == "2-HIGH", F.col("start_date") < F.lit("2000-01-01").cast("date"), F.col("price") > 100000])
    return kept.select("event_id")


@BOOK.add("""
, w AS (SELECT DISTINCT trim(s_name) AS name FROM supplier UNION SELECT lower(city_name) FROM cities UNION SELECT 'District ' || city_id FROM cities),
r AS (SELECT name, (SELECT min(city_id) FROM cities WHERE lower(city_name) = lower(name)) AS c, (SELECT min(city_id) FROM cities WHERE 'district ' || city_id = lower(name) AND city_id % 2 = 0) AS d FROM w)
SELECT name, coalesce(c, d, (SELECT max(city_id) FROM cities) + dense_rank() OVER (PARTITION BY c IS NULL AND d IS NULL ORDER BY lower(name))) AS city_id, CASE WHEN c IS NOT NULL THEN 'name' WHEN d IS NOT NULL THEN 'district' ELSE 'created' END AS how FROM r""")
def j13_resolved_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names are new cities, those of every other district are known."""
    c, s = bind.cities(spark, sf_dir), bind.table(spark, sf_dir, "supplier")
    district = F.concat(F.lit("District "), F.col("city_id").cast("string"))
    names = s.select(F.col("s_name").alias("name")).union(c.select(F.lower("city_name"))).union(c.select(district))
    return writes.resolved_cities(names, c, c.filter("city_id % 2 = 0").select(district.alias("district"), "city_name"), "X")


@BOOK.add("SELECT event_type AS source, count(*) FILTER (WHERE value > 50) AS passed, count(*) FILTER (WHERE NOT value > 50) AS failed FROM events GROUP BY 1", catalog=False)
def a25_probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.probe_summary(bind.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), (F.col("value") > 50).alias("ok")))


@BOOK.add("SELECT venue_id, city_id, n AS n_events, row_number() OVER (PARTITION BY city_id ORDER BY n DESC, venue_id) AS rank FROM venues JOIN (SELECT venue_id, count(*) AS n FROM ev GROUP BY 1) USING (venue_id) WHERE venue_id % 2 = 0")
def j16_ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bind.catalog_events(spark, sf_dir).groupBy("venue_id").agg(F.count(F.lit(1)).alias("n_events"))
    return writes.ranked_candidates(bind.venues(spark, sf_dir), n.withColumn("ok", F.col("venue_id") % 2 == 0), "venue_id").select("venue_id", "city_id", "n_events", "rank")


_SOURCES = ["ticketmaster", "bandsintown", "venue_web", "other"]
_DUPES = """
, dup AS (SELECT event_id, venue_id, ['ticketmaster', 'bandsintown', 'venue_web', 'other'][1 + event_id % 4] AS scrape_source, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN price END AS price, CASE WHEN event_id % 3 = 1 THEN 'USD' END AS price_currency,
  CASE WHEN event_id % 5 = 0 THEN 'L' || event_id END AS purchase_link, CASE WHEN event_id % 7 = 0 THEN 'I' || event_id END AS image_url, CASE WHEN event_id % 2 = 0 THEN '20:00' END AS start_time, CASE WHEN event_id % 4 <> 0 THEN artist_name END AS artist_name, 'd' AS description, venue_id AS cluster FROM ev LEFT JOIN artists USING (event_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CASE scrape_source WHEN 'ticketmaster' THEN 10 WHEN 'bandsintown' THEN 8 WHEN 'venue_web' THEN 3 ELSE 1 END DESC,
  (purchase_link IS NOT NULL)::INT + (coalesce(price, 0) <> 0)::INT + (image_url IS NOT NULL)::INT + (start_time IS NOT NULL)::INT + (artist_name IS NOT NULL)::INT DESC, event_id) AS k FROM dup),
g AS (SELECT cluster, count(*) AS n_members, arg_min(price, event_id) FILTER (WHERE coalesce(price, 0) <> 0) AS dp, arg_min(purchase_link, event_id) FILTER (WHERE purchase_link IS NOT NULL) AS dl, arg_min(image_url, event_id) FILTER (WHERE image_url IS NOT NULL) AS di, arg_min(start_time, event_id) FILTER (WHERE start_time IS NOT NULL) AS ds, arg_min(artist_name, event_id) FILTER (WHERE artist_name IS NOT NULL) AS da FROM dup GROUP BY 1)
SELECT event_id, CASE WHEN coalesce(price, 0) <> 0 OR dp IS NULL THEN price ELSE dp END AS price, CASE WHEN coalesce(price, 0) <> 0 OR dp IS NULL THEN price_currency ELSE 'USD' END AS price_currency, coalesce(purchase_link, dl) AS purchase_link, coalesce(image_url, di) AS image_url, coalesce(start_time, ds) AS start_time, coalesce(artist_name, da) AS artist_name, n_members FROM r JOIN g USING (cluster) WHERE k = 1"""


def _dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, ev = F.col("event_id"), bind.catalog_events(spark, sf_dir).join(bind.event_artists(spark, sf_dir), "event_id", "left").join(bind.match_ups(spark, sf_dir).select("event_id", F.col("event_name").alias("name")), "event_id", "left")
    return ev.select(
        "event_id", "venue_id", "start_date", "name", F.get(F.array(*map(F.lit, _SOURCES)), (i % 4).cast("int")).alias("scrape_source"), F.when(i % 3 == 0, 0.0).when(i % 3 == 1, F.col("price")).alias("price"), F.when(i % 3 == 1, "USD").alias("price_currency"),
        F.when(i % 5 == 0, F.concat(F.lit("L"), i.cast("string"))).alias("purchase_link"), F.when(i % 7 == 0, F.concat(F.lit("I"), i.cast("string"))).alias("image_url"), F.when(i % 2 == 0, "20:00").alias("start_time"), F.when(i % 4 != 0, F.col("artist_name")).alias("artist_name"), F.lit("d").alias("description"),
    )


@BOOK.add(_DUPES)
def d04_merged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a venue as one cluster: keeper, merged fields, number of members."""
    rows = _dupes(spark, sf_dir).withColumn("cluster", F.col("venue_id"))
    return resolve.merged_duplicates(rows, "cluster").select("event_id", "price", "price_currency", "purchase_link", "image_url", "start_time", "artist_name", "n_members")


@BOOK.add()
def q18_dedup_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duplicates job with its counts beside each event; greedy order has no SQL, tests hold it."""
    kept, counts = resolve.dedup(landed(_dupes(spark, sf_dir)))
    return kept.crossJoin(F.broadcast(counts)).select("event_id", "price", "artist_name", "groups_checked", "duplicates_removed")


_CSV = ["Event", "Artist", "Date", "Start Time", "End Time", "Venue", "City", "Country", "Price", "Currency", "Category", "Format", "Genre", "Link", "YouTube"]


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir)
    joined = lambda x: F.array_join(F.array_sort(F.collect_list(F.struct("type_id", x)))[x], ", ").alias(x)
    own = c.bridge.join(c.types, "type_id").groupBy("event_id").agg(joined("category"), joined("type_name"))
    genre = c.artist_genres.filter("primary_genre <> 'UNKNOWN'").select(F.col("normalized_name").alias("_key"), "primary_genre")
    rows = wide(spark, sf_dir).filter(F.col("start_date") >= F.lit(bind.AS_OF_DATE)).join(c.venues, "venue_id", "left").join(c.cities, "city_id", "left").join(own, "event_id", "left")
    return rows.withColumn("_key", F.lower("artist_name")).join(genre, "_key", "left")


@BOOK.add(f"""{_WIDE.rstrip()}
, own AS (SELECT event_id, string_agg(category, ', ' ORDER BY type_id, category) AS category, string_agg(type_name, ', ' ORDER BY type_id, type_name) AS type_name FROM bridge JOIN types USING (type_id) GROUP BY 1)
SELECT coalesce(name, '') AS "Event", coalesce(artist_name, '') AS "Artist", start_date::VARCHAR AS "Date", coalesce(start_time, '') AS "Start Time", '' AS "End Time", coalesce(venue_name, '') AS "Venue", coalesce(city_name, '') AS "City", coalesce(country, '') AS "Country", floor(price)::BIGINT::VARCHAR AS "Price", 'USD' AS "Currency",
 coalesce(category, '') AS "Category", coalesce(type_name, '') AS "Format", coalesce(primary_genre, '') AS "Genre", coalesce(website_url, '') AS "Link", '' AS "YouTube"
FROM wide LEFT JOIN venues USING (venue_id) LEFT JOIN cities USING (city_id) LEFT JOIN own USING (event_id) LEFT JOIN (SELECT * FROM genres WHERE primary_genre <> 'UNKNOWN') g ON normalized_name = lower(artist_name) WHERE {_UP}""")
def k01_full_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen columns of the event file; whole prices, so that engines write numbers alike."""
    rows = _typed(spark, sf_dir).select(
        F.col("name").alias("Event"), F.col("artist_name").alias("Artist"), F.col("start_date").alias("Date"), F.col("start_time").alias("Start Time"), F.lit(None).alias("End Time"), F.col("venue_name").alias("Venue"), F.col("city_name").alias("City"), F.col("country").alias("Country"),
        F.floor("price").alias("Price"), F.lit("USD").alias("Currency"), F.col("category").alias("Category"), F.col("type_name").alias("Format"), F.col("primary_genre").alias("Genre"), F.col("website_url").alias("Link"), F.lit(None).alias("YouTube"),
    )
    return export.csv_columns(rows, _CSV)


@BOOK.add("""
SELECT 'venue' AS kind, venue_id::VARCHAR AS id, venue_name AS name, coalesce(city_name, '') AS place, coalesce(website_url, '') AS extra FROM venues LEFT JOIN cities USING (city_id)
UNION ALL SELECT 'performer', s_suppkey::VARCHAR, s_name, '', coalesce(primary_genre, '') FROM supplier LEFT JOIN genres ON normalized_name = lower(s_name)
UNION ALL SELECT 'city', city_id::VARCHAR, city_name, country, '' FROM cities
UNION ALL SELECT 'event', event_id::VARCHAR, coalesce(artist_name, ''), start_date::VARCHAR, scrape_source FROM ev LEFT JOIN artists USING (event_id) WHERE scrape_source = '2-HIGH'""")
def k02_admin_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four administrative files, each with its kind: venues, performers, cities, and the events of one source."""
    c = bound(spark, sf_dir)
    s = bind.table(spark, sf_dir, "supplier").withColumn("normalized_name", F.lower("s_name")).join(c.artist_genres, "normalized_name", "left")
    own = c.events.filter(F.col("scrape_source") == "2-HIGH").join(c.artists, "event_id", "left")
    part = lambda df, kind, *cols: export.csv_columns(df.select(F.lit(kind).alias("kind"), *[x.alias(n) for n, x in zip(("id", "name", "place", "extra"), cols, strict=True)]), ["kind", "id", "name", "place", "extra"])
    return (
        part(c.venues.join(c.cities, "city_id", "left"), "venue", F.col("venue_id"), F.col("venue_name"), F.col("city_name"), F.col("website_url"))
        .union(part(s, "performer", F.col("s_suppkey"), F.col("s_name"), F.lit(None), F.col("primary_genre")))
        .union(part(c.cities, "city", F.col("city_id"), F.col("city_name"), F.col("country"), F.lit(None)))
        .union(part(own, "event", F.col("event_id"), F.col("artist_name"), F.col("start_date"), F.col("scrape_source")))
    )


@BOOK.add(f"""{_WIDE.rstrip()}
SELECT event_id, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || event_id, 'SUMMARY:' || coalesce(name, 'Untitled Event'),
 CASE WHEN start_time IS NULL THEN 'DTSTART;VALUE=DATE:' || strftime(start_date, '%Y%m%d') ELSE 'DTSTART;TZID=Asia/Tokyo:' || strftime(start_date, '%Y%m%d') || 'T' || replace(start_time, ':', '') || '00' END,
 CASE start_time WHEN '20:00' THEN 'DTEND;TZID=Asia/Tokyo:' || strftime(start_date, '%Y%m%d') || 'T220000' WHEN '23:30' THEN 'DTEND;TZID=Asia/Tokyo:' || strftime(start_date + INTERVAL 1 DAY, '%Y%m%d') || 'T013000' END,
 'LOCATION:' || replace(venue_name, ',', chr(92) || ','), 'URL:' || website_url, CASE WHEN artist_name IS NOT NULL OR website_url IS NOT NULL THEN replace(concat_ws(chr(10) || chr(10), 'Artist: ' || artist_name, 'Buy tickets: ' || website_url), chr(10), chr(92) || 'n') END, 'END:VEVENT') AS entry
FROM (SELECT * REPLACE (CASE WHEN length(artist_name) > 0 THEN artist_name END AS artist_name) FROM wide) LEFT JOIN venues USING (venue_id) WHERE {_UP} AND length(coalesce(name, '')) < 40 AND website_url IS NULL AND artist_name IS NULL""")
def k03_calendar_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a zone, of events without a link or an artist, whose lines need no folding (folding is tested by itself)."""
    rows = wide(spark, sf_dir).filter(F.col("start_date") >= F.lit(bind.AS_OF_DATE)).join(bind.venues(spark, sf_dir), "venue_id", "left").filter((F.length(F.coalesce("name", F.lit(""))) < 40) & F.col("website_url").isNull() & F.col("artist_name").isNull())
    none = F.lit(None).cast("string")
    e = {"uid": F.col("event_id"), "name": F.col("name"), "start_date": F.col("start_date"), "start_time": F.col("start_time"), "end_date": F.lit(None).cast("date"), "end_time": none, "zone": F.lit("Asia/Tokyo"), "venue_name": F.col("venue_name"), "link": F.col("website_url"), "artist_name": F.col("artist_name")}
    return rows.select("event_id", export.ics_full_entry(e).alias("entry"))


@BOOK.add(f"""{_WIDE.rstrip()}
, own AS (SELECT event_id, string_agg(category, ', ' ORDER BY type_id, category) AS category FROM bridge JOIN types USING (type_id) GROUP BY 1)
SELECT event_id, concat_ws('|', coalesce(name, ''), coalesce(artist_name, ''), start_date::VARCHAR, coalesce(start_time, ''), '', '', coalesce(venue_name, ''), coalesce(city_name, ''), CASE WHEN price <> 0 THEN floor(price)::BIGINT::VARCHAR ELSE '' END, 'USD', coalesce(website_url, ''), coalesce(category, ''), scrape_source) AS sheet_row
FROM wide LEFT JOIN venues USING (venue_id) LEFT JOIN cities USING (city_id) LEFT JOIN own USING (event_id) WHERE {_UP}""")
def k04_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen columns of a spreadsheet row, joined by bars."""
    cells = [F.col("name"), F.col("artist_name"), F.col("start_date").cast("string"), F.col("start_time"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("venue_name"), F.col("city_name"), F.when(F.col("price") != 0, F.floor("price").cast("string")), F.lit("USD"), F.col("website_url"), F.col("category"), F.col("scrape_source")]
    return _typed(spark, sf_dir).select("event_id", F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cells]).alias("sheet_row"))


@BOOK.add("SELECT 'AC/DC, Rock · ' || 'Jazz Night · ' || (SELECT string_agg(city_name, ', ' ORDER BY city_name) FROM (SELECT DISTINCT city_name FROM cities WHERE city_id IN (3, 5, 7, 9) ORDER BY 1 LIMIT 3)) || ' – Events' AS label".replace("AC/DC, Rock · ", "AC/DC · Rock · "))
def k05_calendar_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.calendar_label(["AC/DC"], ["Rock"], ["jazz night"], bind.cities(spark, sf_dir), [3, 5, 7, 9], "Events")


@BOOK.add("SELECT s_name AS artist_name, ((row_number() OVER (ORDER BY s_name) - 1) // 7)::BIGINT AS batch FROM supplier")
def k06_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists in batches of seven, in order."""
    return export.batches(bind.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("artist_name")), ["artist_name"], 7)


@BOOK.add("SELECT p_name AS performer, count(*) AS n_events FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 UNION ALL SELECT DISTINCT upper(p_name) || '?', 0 FROM part", catalog=False)
def j03_lower_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left outer join on lower-cased keys, counted before the join."""
    p, li = bind.table(spark, sf_dir, "part"), bind.table(spark, sf_dir, "lineitem")
    n = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.lower("p_name").alias("_key")).agg(F.sum("n").alias("n"))
    names = p.select(F.col("p_name").alias("performer")).union(p.select(F.concat(F.upper("p_name"), F.lit("?")))).distinct()
    return names.withColumn("_key", F.lower("performer")).join(n, "_key", "left").select("performer", F.coalesce("n", F.lit(0)).alias("n_events"))


@BOOK.add(f"SELECT venue_id, min(lpad(event_id::VARCHAR, 9, '0')) AS source_id FROM ev WHERE {_UP} GROUP BY 1")
def a10_first_source_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = bind.catalog_events(spark, sf_dir).filter(F.col("start_date") >= F.lit(bind.AS_OF_DATE))
    return ev.groupBy("venue_id").agg(F.min(F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("source_id"))


@BOOK.add("SELECT city_id, city_name, country FROM cities WHERE contains(lower(city_name), 'n_1') OR contains(lower(country), 'asi') OR contains(lower(city_name || ', ' || country), '4, eur')")
def p20_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three terms of a place box, each in the city, the country, or both."""
    c = bind.cities(spark, sf_dir)
    return c.filter(T.any_of([T.place_matches(t, F.col("city_name"), F.col("country")) for t in ("n_1", "Asi", "4, eur")]))


@BOOK.add("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_all, coalesce(b.n, 0) AS n_up FROM (SELECT scrape_source AS k, count(*) AS n FROM ev WHERE price > 100 GROUP BY 1) a FULL JOIN (SELECT scrape_source AS k, count(*) AS n FROM ev WHERE start_date >= DATE '2001-01-01' GROUP BY 1) b USING (k)")
def u03_union_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of either set with both counts, in one pass."""
    a, b = F.col("price") > 100, F.col("start_date") >= F.lit(bind.AS_OF_DATE)
    return bind.catalog_events(spark, sf_dir).filter(a | b).groupBy(F.col("scrape_source").alias("k")).agg(F.count(F.when(a, 1)).alias("n_all"), F.count(F.when(b, 1)).alias("n_up"))


@BOOK.add("SELECT v.venue_id, city_name, n AS n_events FROM venues v JOIN cities USING (city_id) JOIN (SELECT venue_id, count(*) AS n FROM ev GROUP BY 1 HAVING min(start_date) >= DATE '1999-06-01') USING (venue_id)")
def j07_new_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues whose first event is of the last years: a join on an aggregate."""
    c = bound(spark, sf_dir)
    new = c.events.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("start_date").alias("d")).filter(F.col("d") >= F.lit("1999-06-01").cast("date"))
    return c.venues.join(new, "venue_id").join(c.cities, "city_id").select("venue_id", "city_name", "n_events")


@BOOK.add("SELECT s_name, row_number() OVER (ORDER BY lower(s_name), s_name) AS place FROM supplier ORDER BY lower(s_name), s_name LIMIT 30")
def l07_case_blind_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty names whatever their case, a report; the rank is of those only."""
    from pyspark.sql import Window

    top = bind.table(spark, sf_dir, "supplier").select("s_name").orderBy(F.lower("s_name"), "s_name").limit(30)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.lower("s_name"), "s_name")))

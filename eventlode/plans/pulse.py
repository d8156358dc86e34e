"""The pulse's added and aged-out halves from daily rollups, rotating batches by a durable cursor, health as a stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlode.operators import cursor, rollup
from eventlode.plans.book import Book
from eventlode.plans.streams import drained, shared_folder
from eventlode.sources import bind
from eventlode.streaming import health

BOOK = Book()
DAYS = 30
#: Events with the day they were stored, which the derived catalog puts up to 59 days before their date.
_SQL = """
, e AS (SELECT event_id, venue_id, city_id, artist_id, scrape_source, start_date, (start_date - (event_id % 60)::INT)::DATE AS created FROM ev JOIN venues USING (venue_id)
  LEFT JOIN (SELECT l_orderkey::BIGINT AS event_id, min(l_suppkey)::BIGINT AS artist_id FROM lineitem GROUP BY 1) USING (event_id)),
k AS (SELECT 'events' AS kind, event_id AS id, scrape_source, created, start_date FROM e UNION ALL SELECT 'venues', venue_id, scrape_source, created, start_date FROM e
  UNION ALL SELECT 'cities', city_id, scrape_source, created, start_date FROM e UNION ALL SELECT 'artists', artist_id, scrape_source, created, start_date FROM e WHERE artist_id IS NOT NULL)"""


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = bind.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("event_id")).agg(F.min("l_suppkey").alias("artist_id"))
    ev = bind.catalog_events(spark, sf_dir).join(bind.venues(spark, sf_dir).select("venue_id", "city_id"), "venue_id").join(first, "event_id", "left")
    return ev.withColumn("created", F.date_sub("start_date", (F.col("event_id") % 60).cast("int")))


def catalog_rollup(events: DataFrame, day: str) -> DataFrame:
    """Events, venues, cities and artists per day and source."""
    return rollup.daily(events, day, ["scrape_source"], {"events": "event_id", "venues": "venue_id", "cities": "city_id", "artists": "artist_id"})


def pulse(stored: DataFrame, dated: DataFrame, as_of: dt.date, days: int = 1) -> DataFrame:
    """kind; what was added and what aged out in the last `days` days and in as many before, from rollups by day of storing and by date."""
    now, last, before = (F.lit(as_of - dt.timedelta(days=days * n)) for n in (0, 1, 2))
    recent, older = (F.col("day") >= last) & (F.col("day") < now), (F.col("day") >= before) & (F.col("day") < last)
    within = (F.col("day") >= before) & (F.col("day") < now)
    came = rollup.distinct_in(stored.filter(within), {"added": recent, "added_before": older}, [])
    went = rollup.distinct_in(dated.filter(within), {"aged_out": recent, "aged_before": older}, [])
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("added", "added_before", "aged_out", "aged_before")]
    return came.join(went, "kind", "full").select("kind", *counts)


@BOOK.add(_SQL + f"""
SELECT * FROM (SELECT kind, count(DISTINCT id) FILTER (created >= d - {DAYS} AND created < d) AS added, count(DISTINCT id) FILTER (created >= d - {2 * DAYS} AND created < d - {DAYS}) AS added_before,
 count(DISTINCT id) FILTER (start_date >= d - {DAYS} AND start_date < d) AS aged_out, count(DISTINCT id) FILTER (start_date >= d - {2 * DAYS} AND start_date < d - {DAYS}) AS aged_before
FROM k, (SELECT DATE '2001-01-01' AS d) GROUP BY 1) WHERE added + added_before + aged_out + aged_before > 0""")
def q08_added_and_aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of the pulse for all kinds, over spans of 30 days."""
    ev = stored_events(spark, sf_dir)
    return pulse(catalog_rollup(ev, "created"), catalog_rollup(ev, "start_date"), bind.AS_OF_DATE, DAYS)


@BOOK.add(_SQL + f"""
SELECT scrape_source, count(DISTINCT id) FILTER (kind = 'events') AS all_events, count(DISTINCT id) FILTER (kind = 'events' AND created >= DATE '2001-01-01' - {DAYS} AND created < DATE '2001-01-01') AS new_events,
 count(DISTINCT id) FILTER (kind = 'venues') AS all_venues, count(DISTINCT id) FILTER (kind = 'venues' AND created >= DATE '2001-01-01' - {DAYS} AND created < DATE '2001-01-01') AS new_venues,
 count(DISTINCT id) FILTER (kind = 'cities') AS all_cities, count(DISTINCT id) FILTER (kind = 'cities' AND created >= DATE '2001-01-01' - {DAYS} AND created < DATE '2001-01-01') AS new_cities FROM k GROUP BY 1""")
def q09_source_matrix_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of sources with what is new, of a rollup that came in two parts."""
    ev = stored_events(spark, sf_dir)
    early, late = (catalog_rollup(ev.filter(f"event_id % 2 = {n}"), "created") for n in (0, 1))  # both halves of the table, as of two loads
    new = (F.col("day") >= F.lit(bind.AS_OF_DATE - dt.timedelta(days=DAYS))) & (F.col("day") < F.lit(bind.AS_OF_DATE))
    n = rollup.distinct_in(rollup.added(early, late), {"all": F.lit(True), "new": new}, ["scrape_source"])
    cells = [F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(span))), F.lit(0)).alias(f"{span}_{kind}") for kind in ("events", "venues", "cities") for span in ("all", "new")]
    return n.groupBy("scrape_source").agg(*cells)


@BOOK.add(_SQL + """
, a AS (SELECT created AS day, count(*) AS added FROM e GROUP BY 1), g AS (SELECT start_date AS day, count(*) AS aged FROM e GROUP BY 1)
SELECT day, coalesce(added, 0) AS added, coalesce(aged, 0) AS aged, coalesce(added, 0) - coalesce(aged, 0) AS net FROM a FULL JOIN g USING (day)""")
def w08_added_against_aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events added and aged out on each day, and their difference."""
    ev, always = stored_events(spark, sf_dir), F.lit(True)
    came, went = (rollup.distinct_in(rollup.daily(ev, day, [], {"events": "event_id"}), {name: always}, ["day"]).drop("kind") for day, name in (("created", "added"), ("start_date", "aged")))
    both = came.join(went, "day", "full").select("day", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("aged", F.lit(0)).alias("aged"))
    return both.withColumn("net", F.col("added") - F.col("aged"))


@BOOK.add("""
, o AS (SELECT venue_id, row_number() OVER (ORDER BY venue_name, venue_id) - 1 AS pos, count(*) OVER () AS n FROM venues), t AS (SELECT unnest(range(3)) AS turn)
SELECT turn, (pos - turn * 40 + n) % n AS place, venue_id FROM o, t WHERE (pos - turn * 40 + n) % n < 40""")
def t02_rotating_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three turns of 40 venues from a new cursor on."""
    own, venues = cursor.Cursor(spark, shared_folder(spark)), bind.venues(spark, sf_dir)
    turns = [cursor.next_batch(own, venues, ["venue_name", "venue_id"], 40) for _ in range(3)]
    return turns[0].union(turns[1]).union(turns[2]).select("turn", "place", "venue_id")


@BOOK.add("""
, l AS (SELECT log_id, job_name, detail // 5 AS detail, started_at, events_found // 10 AS events_found FROM logs),
r AS (SELECT *, row_number() OVER (PARTITION BY job_name, detail ORDER BY started_at DESC, log_id DESC) AS r FROM l QUALIFY r <= 5)
SELECT job_name, detail, count(*) AS runs, count(*) FILTER (WHERE events_found = 0) AS zeros, max(started_at) AS last_run, max(CASE WHEN r = 1 THEN events_found END) AS last_found,
 count(*) FILTER (WHERE events_found = 0) >= 3 AND coalesce(max(events_found) > 0, false) AS alert FROM r GROUP BY ALL""")
def t07_stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health of each source after the stream of runs has been drained."""
    rows = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(sf_dir + "/events.parquet*")
    runs = rows.select(F.col("event_id").cast("long").alias("log_id"), F.col("event_type").alias("job_name"), F.floor(F.col("user_id") / 5).alias("detail"), F.col("ts").cast("timestamp").alias("started_at"), F.floor(F.col("value").cast("long") / 10).alias("events_found"))
    return health.current(drained(health.source_health_stream(runs))).withColumn("last_run", F.col("last_run").cast("timestamp_ntz"))

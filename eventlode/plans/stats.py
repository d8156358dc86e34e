"""Statistics: coverage, breakdowns, source health, daily pulse, source matrix, roll-ups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlode.functions import text as T
from eventlode.operators import contain
from eventlode.plans.book import Book
from eventlode.plans.search import bound
from eventlode.sources import bind

BOOK = Book()
_UP = "start_date >= DATE '2001-01-01'"
_TS = "TIMESTAMP '2024-01-30'"


def upcoming(df: DataFrame, as_of: dt.date = bind.AS_OF_DATE) -> DataFrame:
    return df.filter(F.col("start_date") >= F.lit(as_of))


@BOOK.add("""
SELECT count(*) AS venues, count(website_url) AS with_website, count(*) FILTER (WHERE venue_type = 'BUILDING') AS buildings,
 round_even(count(website_url) * 100.0 / count(*), 0)::BIGINT AS website_percent FROM venues""")
def a16_venue_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of conditional counts."""
    v = bind.venues(spark, sf_dir).agg(F.count(F.lit(1)).alias("venues"), F.count("website_url").alias("with_website"), F.count(F.when(F.col("venue_type") == "BUILDING", 1)).alias("buildings"))
    return v.withColumn("website_percent", T.percent(F.col("with_website"), F.col("venues")))


def source_health(logs: DataFrame, last: int = 400, per_source: int = 5) -> DataFrame:
    """Of the last runs overall, each source's last few: alert if three or more found nothing but not all."""
    recent = logs.orderBy(F.desc("started_at"), F.desc("log_id")).limit(last)
    w = Window.partitionBy("job_name", "detail").orderBy(F.desc("started_at"), F.desc("log_id"))
    own = recent.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_source)
    zero = F.count(F.when(F.col("events_found") == 0, 1))
    return own.groupBy("job_name", "detail").agg(F.count(F.lit(1)).alias("runs"), zero.alias("zeros"), F.max("started_at").alias("last_run"), F.max(F.when(F.col("r") == 1, F.col("events_found"))).alias("last_found"), ((zero >= 3) & (F.max("events_found") > 0)).alias("alert"))


@BOOK.add("""
, l AS (SELECT * FROM (SELECT log_id, job_name, detail // 50 AS detail, started_at, events_found // 10 AS events_found FROM logs) ORDER BY started_at DESC, log_id DESC LIMIT 400),
r AS (SELECT *, row_number() OVER (PARTITION BY job_name, detail ORDER BY started_at DESC, log_id DESC) AS r FROM l QUALIFY r <= 5)
SELECT job_name, detail, count(*) AS runs, count(*) FILTER (WHERE events_found = 0) AS zeros, max(started_at) AS last_run, max(CASE WHEN r = 1 THEN events_found END) AS last_found,
 count(*) FILTER (WHERE events_found = 0) >= 3 AND max(events_found) > 0 AS alert FROM r GROUP BY ALL""")
def w01_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = bind.scan_logs(spark, sf_dir).withColumn("detail", F.floor(F.col("detail") / 50)).withColumn("events_found", F.floor(F.col("events_found") / 10))
    return source_health(logs)


@BOOK.add("SELECT city_id, city_name, count(DISTINCT event_id) AS n_events FROM cities JOIN venues USING (city_id) JOIN ev USING (venue_id) WHERE start_date >= DATE '2001-07-01' GROUP BY ALL HAVING count(DISTINCT event_id) < 40")
def q05_thin_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities with some, but few, upcoming events; the venue's count comes before its city."""
    c = bound(spark, sf_dir)
    per_venue = upcoming(c.events, dt.date(2001, 7, 1)).groupBy("venue_id").agg(F.countDistinct("event_id").alias("n"))
    return per_venue.join(c.venues.select("venue_id", "city_id"), "venue_id").join(c.cities, "city_id").groupBy("city_id", "city_name").agg(F.sum("n").alias("n_events")).filter("n_events < 40")


@BOOK.add(f"SELECT category, count(DISTINCT event_id) AS n_events, count(DISTINCT type_id) AS n_types FROM ev JOIN bridge USING (event_id) JOIN types USING (type_id) WHERE {_UP} GROUP BY 1")
def q06_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir)
    return upcoming(c.events).select("event_id").join(c.bridge, "event_id").join(c.types, "type_id").groupBy("category").agg(F.countDistinct("event_id").alias("n_events"), F.countDistinct("type_id").alias("n_types"))


@BOOK.add(f"SELECT type_name, count(DISTINCT event_id) AS n_events FROM ev JOIN bridge USING (event_id) JOIN types USING (type_id) WHERE {_UP} GROUP BY 1 ORDER BY n_events DESC, type_name LIMIT 20")
def q06_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty commonest type names: a report, so the limit is the feature."""
    c = bound(spark, sf_dir)
    return upcoming(c.events).select("event_id").join(c.bridge, "event_id").join(c.types, "type_id").groupBy("type_name").agg(F.countDistinct("event_id").alias("n_events")).orderBy(F.desc("n_events"), "type_name").limit(20)


@BOOK.add(f"SELECT city_name, country, count(*) AS events, sum(CASE WHEN sport IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS sports, min(start_date) AS first_date FROM ev JOIN venues USING (venue_id) JOIN cities USING (city_id) WHERE {_UP} AND scrape_source = '2-HIGH' GROUP BY ALL")
def q07_source_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir)
    own = upcoming(c.events).filter(F.col("scrape_source") == "2-HIGH")
    return own.join(c.venues, "venue_id").join(c.cities, "city_id").groupBy("city_name", "country").agg(F.count(F.lit(1)).alias("events"), F.sum(F.when(F.col("sport").isNotNull(), 1).otherwise(0)).alias("sports"), F.min("start_date").alias("first_date"))


def daily_pulse(logs: DataFrame, as_of: dt.datetime, compat: bool = True) -> DataFrame:
    """The last 24 hours against the 24 before, in one pass of conditional aggregates.

    compat: the day's total of different details is the sum over jobs, the day before's is over all; else both over all.
    """
    now, day, two = F.lit(as_of), F.lit(as_of - dt.timedelta(days=1)), F.lit(as_of - dt.timedelta(days=2))
    today = (F.col("started_at") >= day) & (F.col("started_at") < now)
    before = (F.col("started_at") >= two) & (F.col("started_at") < day)
    recent = logs.filter((F.col("started_at") >= two) & (F.col("started_at") < now))
    per_job = recent.groupBy("job_name").agg(F.count(F.when(today, 1)).alias("runs"), F.count(F.when(before, 1)).alias("runs_before"), F.coalesce(F.sum(F.when(today, F.col("events_found"))), F.lit(0)).alias("found"), F.countDistinct(F.when(today, F.col("detail"))).alias("details"))
    total = recent.agg(F.countDistinct(F.when(today, F.col("detail"))).alias("all_today"), F.countDistinct(F.when(before, F.col("detail"))).alias("all_before"))
    summed = per_job.agg(F.coalesce(F.sum("details"), F.lit(0)).alias("s"))
    head = total.crossJoin(F.broadcast(summed)).select(F.col("s").alias("details_total") if compat else F.col("all_today").alias("details_total"), "all_before")
    return per_job.crossJoin(F.broadcast(head))


@BOOK.add(f"""
, r AS (SELECT *, started_at >= {_TS} - INTERVAL 1 DAY AS t FROM logs WHERE started_at >= {_TS} - INTERVAL 2 DAY AND started_at < {_TS}),
j AS (SELECT job_name, count(*) FILTER (WHERE t) AS runs, count(*) FILTER (WHERE NOT t) AS runs_before, coalesce(sum(events_found) FILTER (WHERE t), 0)::BIGINT AS found, count(DISTINCT detail) FILTER (WHERE t) AS details FROM r GROUP BY 1)
SELECT *, (SELECT sum(details)::BIGINT FROM j) AS details_total, (SELECT count(DISTINCT detail) FILTER (WHERE NOT t) FROM r) AS all_before FROM j""")
def q08_daily_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_pulse(bind.scan_logs(spark, sf_dir), bind.AS_OF_TS)


@BOOK.add(f"""
, g AS (SELECT city_id, city_name, country, scrape_source, count(*) AS n FROM ev JOIN venues USING (venue_id) JOIN cities USING (city_id) WHERE {_UP} GROUP BY ALL)
SELECT city_name, country, sum(n)::BIGINT AS total, string_agg(scrape_source || ':' || n, ',' ORDER BY n DESC, scrape_source) AS by_source FROM g GROUP BY ALL""")
def a17_city_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir)
    g = upcoming(c.events).join(c.venues, "venue_id").join(c.cities, "city_id").groupBy("city_id", "city_name", "country", "scrape_source").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "scrape_source", "n")))
    return g.groupBy("city_name", "country").agg(F.sum("n").alias("total"), F.array_join(F.transform(listed, lambda x: F.concat(x["scrape_source"], F.lit(":"), x["n"].cast("string"))), ",").alias("by_source"))


@BOOK.add(f"""
, m AS (SELECT scrape_source, count(DISTINCT event_id) AS all_events, count(DISTINCT CASE WHEN {_UP} THEN event_id END) AS up_events, count(DISTINCT venue_id) AS all_venues, count(DISTINCT CASE WHEN {_UP} THEN venue_id END) AS up_venues FROM ev GROUP BY 1)
SELECT *, round_even(up_events * 100.0 / sum(up_events) OVER (), 0)::BIGINT AS up_percent FROM m""")
def q09_source_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = bind.catalog_events(spark, sf_dir)
    up = F.col("start_date") >= F.lit(bind.AS_OF_DATE)
    m = ev.groupBy("scrape_source").agg(F.countDistinct("event_id").alias("all_events"), F.countDistinct(F.when(up, F.col("event_id"))).alias("up_events"), F.countDistinct("venue_id").alias("all_venues"), F.countDistinct(F.when(up, F.col("venue_id"))).alias("up_venues"))
    return m.crossJoin(F.broadcast(m.agg(F.sum("up_events").alias("t")))).withColumn("up_percent", T.percent(F.col("up_events"), F.col("t"))).drop("t")


@BOOK.add(f"SELECT split_part(scrape_source, '-', 1) AS tag, count(*) AS n_events, count(*) FILTER (WHERE {_UP}) AS upcoming, max(start_date) AS last_date FROM ev GROUP BY 1")
def q10_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the prefix tag in one pass."""
    up = F.col("start_date") >= F.lit(bind.AS_OF_DATE)
    return bind.catalog_events(spark, sf_dir).groupBy(F.split_part("scrape_source", F.lit("-"), F.lit(1)).alias("tag")).agg(F.count(F.lit(1)).alias("n_events"), F.count(F.when(up, 1)).alias("upcoming"), F.max("start_date").alias("last_date"))


@BOOK.add(f"SELECT * FROM cities WHERE city_id IN (SELECT city_id FROM venues WHERE venue_id IN (SELECT venue_id FROM ev WHERE {_UP} AND price > 400000))")
def q11_cities_with_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir)
    dear = upcoming(c.events).filter("price > 400000")
    return c.cities.join(c.venues.join(dear, "venue_id", "left_semi"), "city_id", "left_semi").select("city_id", "city_name", "country")


@BOOK.add("SELECT country, count(DISTINCT city_id) AS n_cities, count(DISTINCT event_id) AS n_events FROM cities JOIN venues USING (city_id) JOIN ev USING (venue_id) GROUP BY 1")
def a18_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir)
    per_venue = c.events.groupBy("venue_id").agg(F.countDistinct("event_id").alias("n"))
    return per_venue.join(c.venues, "venue_id").join(c.cities, "city_id").groupBy("country").agg(F.countDistinct("city_id").alias("n_cities"), F.sum("n").alias("n_events"))


#: Metro areas of the derived catalog: a name, and the cities that it takes in.
METROS = [("north", ["nation_1", "nation_2", "nation_3"]), ("south", ["NATION_10", "nation_11"]), ("nowhere", ["atlantis"])]


def metro_areas(spark: SparkSession, cities: DataFrame, metros: list[tuple[str, list[str]]]) -> DataFrame:
    """Members by lower-cased name, whatever the country; of cities that share a name the smallest id."""
    members = spark.createDataFrame([(m, c.lower()) for m, cs in metros for c in cs], "metro string, key string")
    one = cities.groupBy(F.lower("city_name").alias("key")).agg(F.min("city_id").alias("city_id"), F.min_by("city_name", "city_id").alias("city_name"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("city_id")), lambda x: x.cast("string")), ",")
    return one.join(members, "key").groupBy("metro").agg(F.count(F.lit(1)).alias("n_cities"), ids.alias("city_ids"))


@BOOK.add("""
, m(metro, key) AS (VALUES ('north', 'nation_1'), ('north', 'nation_2'), ('north', 'nation_3'), ('south', 'nation_10'), ('south', 'nation_11'), ('nowhere', 'atlantis'))
SELECT metro, count(*) AS n_cities, string_agg(city_id::VARCHAR, ',' ORDER BY city_id) AS city_ids FROM m JOIN cities ON lower(city_name) = key GROUP BY 1""")
def q12_metro_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metro_areas(spark, bind.cities(spark, sf_dir), METROS)


@BOOK.add("SELECT DISTINCT category FROM types")
def q13_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.event_types(spark, sf_dir).select("category").distinct().orderBy("category")


@BOOK.add("SELECT venue_id, venue_name, venue_type FROM venues WHERE city_id = 5")
def q13_venues_of_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.venues(spark, sf_dir).filter("city_id = 5").select("venue_id", "venue_name", "venue_type").orderBy("venue_name")


@BOOK.add("""
SELECT a.city_id AS a_id, b.city_id AS b_id, a.country FROM cities a JOIN cities b ON a.country = b.country AND (a.city_name, a.city_id) < (b.city_name, b.city_id)
WHERE contains(lower(a.city_name), lower(b.city_name)) OR contains(lower(b.city_name), lower(a.city_name))""")
def q14_city_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one country where one name holds the other, found by the rarest gram of the one that is held."""
    pairs = contain.containing_pairs(bind.cities(spark, sf_dir), F.struct("city_name", "city_id"), "country", F.lower("city_name"))
    return pairs.select(F.least("holder", "held")["city_id"].alias("a_id"), F.greatest("holder", "held")["city_id"].alias("b_id"), "country")


@BOOK.add(f"SELECT scrape_source, count(*) AS n, count(*) FILTER (WHERE {_UP}) AS n_upcoming FROM ev GROUP BY 1")
def q15_admin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.catalog_events(spark, sf_dir).groupBy("scrape_source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("start_date") >= F.lit(bind.AS_OF_DATE), 1)).alias("n_upcoming"))


@BOOK.add("SELECT log_id, detail, started_at, events_found FROM logs WHERE job_name = 'error' ORDER BY started_at DESC, log_id DESC LIMIT 25")
def q16_scan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.scan_logs(spark, sf_dir).filter("job_name = 'error'").orderBy(F.desc("started_at"), F.desc("log_id")).limit(25).select("log_id", "detail", "started_at", "events_found")


@BOOK.add(f"""
SELECT artist_name, count(*) AS n_events FROM ev JOIN artists USING (event_id) WHERE {_UP} AND lower(artist_name) NOT IN (SELECT lower(s_name) FROM supplier WHERE s_acctbal > 5000) GROUP BY 1 ORDER BY n_events DESC, artist_name LIMIT 30""")
def q17_pending_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of unclassified artists with the most upcoming events; those with a balance over 5000 count as classified."""
    c = bound(spark, sf_dir)
    known = bind.table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.lower("s_name").alias("k"))
    n = upcoming(c.events).select("event_id").join(c.artists, "event_id").groupBy("artist_name").agg(F.count(F.lit(1)).alias("n_events")).withColumn("k", F.lower("artist_name"))
    return n.join(known, "k", "left_anti").orderBy(F.desc("n_events"), "artist_name").limit(30).select("artist_name", "n_events")


@BOOK.add(f"SELECT venue_id, venue_name, count(event_id) AS n_events FROM venues LEFT JOIN ev USING (venue_id) WHERE website_url IS NULL GROUP BY ALL ORDER BY n_events DESC, venue_id LIMIT 40")
def q20_venues_missing_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir)
    n = c.events.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"))
    return c.venues.filter(T.blank(F.col("website_url"))).join(n, "venue_id", "left").select("venue_id", "venue_name", F.coalesce("n", F.lit(0)).alias("n_events")).orderBy(F.desc("n_events"), "venue_id").limit(40)


@BOOK.add("""
, g AS (SELECT detail, job_name, count(*) AS n FROM logs GROUP BY 1, 2)
SELECT detail, job_name AS commonest, n FROM g QUALIFY row_number() OVER (PARTITION BY detail ORDER BY n DESC, job_name) = 1""")
def a13_mode_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest value per key, ties to the smaller: a count, then the least of (-count, value)."""
    g = bind.scan_logs(spark, sf_dir).groupBy("detail", "job_name").agg(F.count(F.lit(1)).alias("n"))
    best = g.groupBy("detail").agg(F.min(F.struct((-F.col("n")).alias("o"), "job_name", "n")).alias("b"))
    return best.select("detail", F.col("b.job_name").alias("commonest"), F.col("b.n").alias("n"))


@BOOK.add("SELECT city_id, venue_type, string_agg(venue_id::VARCHAR, ',' ORDER BY venue_id) AS ids, count(*) AS n FROM venues GROUP BY 1, 2")
def a12_ids_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("venue_id")), lambda x: x.cast("string")), ",")
    return bind.venues(spark, sf_dir).groupBy("city_id", "venue_type").agg(ids.alias("ids"), F.count(F.lit(1)).alias("n"))


@BOOK.add(f"""
, d AS (SELECT start_date, count(*) AS added FROM ev GROUP BY 1)
SELECT start_date, added, added - lag(added) OVER (ORDER BY start_date) AS change FROM d""")
def w08_daily_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and their change against the last day that had any: one row a day reaches the window, however many events there are."""
    d = bind.catalog_events(spark, sf_dir).groupBy("start_date").agg(F.count(F.lit(1)).alias("added"))
    return d.withColumn("change", F.col("added") - F.lag("added").over(Window.orderBy("start_date")))


@BOOK.add("SELECT date_trunc('day', started_at) AS day, job_name, count(*) AS runs, max(events_found) AS most FROM logs GROUP BY 1, 2")
def t05_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling one-day windows over the run log."""
    w = F.window(F.col("started_at").cast("timestamp"), "1 day")
    g = bind.scan_logs(spark, sf_dir).groupBy(w.alias("w"), "job_name").agg(F.count(F.lit(1)).alias("runs"), F.max("events_found").alias("most"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "job_name", "runs", "most")

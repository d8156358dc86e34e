"""Catalog tables derived from the star-schema tables that the driver provides."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Today" of the derived catalog, and "now" of its run log.
AS_OF_DATE = dt.date(2001, 1, 1)
AS_OF_TS = dt.datetime(2024, 1, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("city_id"), F.col("n_name").alias("city_name"), F.col("r_name").alias("country"))


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("long").alias("venue_id"),
        F.col("c_name").alias("venue_name"),
        F.col("c_nationkey").cast("long").alias("city_id"),
        F.col("c_mktsegment").alias("venue_type"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("https://venue.example/"), F.col("c_custkey").cast("string"))).alias("website_url"),
    )


def catalog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("long").alias("event_id"),
        F.col("o_custkey").cast("long").alias("venue_id"),
        F.to_date("o_orderdate").alias("start_date"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("scrape_source"),
        F.when(F.col("o_orderstatus") == "P", F.lit("Sports")).alias("sport"),
    )


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("long").alias("type_id"), F.col("p_name").alias("type_name"), F.col("p_type").alias("category"))


def event_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs; an order line is not a key here."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("long").alias("event_id"), F.col("l_partkey").cast("long").alias("type_id")).distinct()


def event_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event's artist: the supplier with the smallest key among its lines."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    first = li.groupBy(F.col("l_orderkey").cast("long").alias("event_id")).agg(F.min("l_suppkey").alias("s"))
    return first.join(s, first.s == s.s_suppkey).select("event_id", F.col("s_name").alias("artist_name"))


def scan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("long").alias("log_id"), F.col("event_type").alias("job_name"), F.col("user_id").cast("long").alias("detail"), F.col("ts").alias("started_at"), F.col("value").cast("long").alias("events_found"))


def genre_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities as sub-genres of their countries: a two-level tree."""
    return cities(spark, sf_dir).select(F.col("city_name").alias("sub_genre"), F.col("country").alias("parent_genre"))


def artist_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the artists with one to two genres; a seventh of these is unknown."""
    s, n = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    other = n.select(F.col("n_nationkey").alias("o_key"), F.col("n_name").alias("o_name"))
    both = s.join(n, s.s_nationkey == n.n_nationkey).join(other, F.expr("o_key = (s_nationkey + 7) % 25"), "left")
    return both.select(
        F.lower("s_name").alias("normalized_name"),
        F.when(F.col("s_suppkey") % 7 == 0, "UNKNOWN").otherwise(F.col("n_name")).alias("primary_genre"),
        F.when((F.col("s_suppkey") % 2 == 0) & (F.col("s_suppkey") % 7 != 0), F.col("o_name")).alias("secondary_1"),
        F.lit(None).cast("string").alias("secondary_2"),
    )


def match_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_name, home_team, away_team: "League - Home vs Away" for sports rows, the first type's name for others."""
    types = event_types(spark, sf_dir)
    first = event_event_types(spark, sf_dir).groupBy("event_id").agg(F.min("type_id").alias("type_id")).join(types, "type_id").select("event_id", "type_name")
    ev = catalog_events(spark, sf_dir).join(venues(spark, sf_dir).select("venue_id", "city_id"), "venue_id").join(cities(spark, sf_dir), "city_id").join(first, "event_id", "left")
    sports = F.col("sport").isNotNull()
    home, away = F.concat(F.col("city_name"), F.lit(" Reds")), F.concat(F.col("country"), F.lit(" Blues"))
    return ev.select("event_id", F.when(sports, F.concat(F.lit("League "), (F.col("event_id") % 3).cast("string"), F.lit(" - "), home, F.lit(" vs "), away)).otherwise(F.col("type_name")).alias("event_name"), F.when(sports, home).alias("home_team"), F.when(sports, away).alias("away_team"))

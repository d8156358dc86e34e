"""City coverage: how many upcoming events each city has, and over which dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlode.sources import bind


def city_coverage(cities: DataFrame, venues: DataFrame, events: DataFrame, as_of: dt.date) -> DataFrame:
    """Per city: distinct upcoming events and venues that hold them, first and last date; cities with a venue only.

    The venue side is reduced to its key columns and the events are aggregated by venue before
    they meet the venues, so the only shuffle of facts is a partial aggregate by venue.
    """
    upcoming = F.col("start_date") >= F.lit(as_of)
    per_venue = (
        events.filter(F.col("venue_id").isNotNull())
        .groupBy("venue_id")
        .agg(
            F.countDistinct(F.when(upcoming, F.col("event_id"))).alias("n"),
            F.min(F.when(upcoming, F.col("start_date"))).alias("lo"),
            F.max(F.when(upcoming, F.col("start_date"))).alias("hi"),
        )
    )
    return (
        cities.join(venues.select("venue_id", "city_id"), "city_id", "left")
        .join(per_venue, "venue_id", "left")
        .groupBy("city_id", "city_name", "country")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("upcoming_events"),
            F.count(F.when(F.col("n") > 0, F.col("venue_id"))).alias("venues_with_events"),
            F.min("lo").alias("first_date"),
            F.max("hi").alias("last_date"),
            F.count("venue_id").alias("venues"),
        )
        .filter(F.col("venues") > 0)
        .orderBy(F.desc("upcoming_events"), "city_id")
    )


def _q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return city_coverage(bind.cities(spark, sf_dir), bind.venues(spark, sf_dir), bind.catalog_events(spark, sf_dir), bind.AS_OF_DATE)


QUERIES = {"q04_city_coverage": _q04}

ORACLE = {
    "q04_city_coverage": """
    SELECT n_nationkey::BIGINT AS city_id, n_name AS city_name, r_name AS country,
      count(DISTINCT CASE WHEN o_orderdate >= DATE '2001-01-01' THEN o_orderkey END) AS upcoming_events,
      count(DISTINCT CASE WHEN o_orderdate >= DATE '2001-01-01' THEN c_custkey END) AS venues_with_events,
      min(CASE WHEN o_orderdate >= DATE '2001-01-01' THEN o_orderdate::DATE END) AS first_date,
      max(CASE WHEN o_orderdate >= DATE '2001-01-01' THEN o_orderdate::DATE END) AS last_date,
      count(DISTINCT c_custkey) AS venues
    FROM nation JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY 1, 2, 3 HAVING count(DISTINCT c_custkey) > 0 ORDER BY upcoming_events DESC, city_id"""
}

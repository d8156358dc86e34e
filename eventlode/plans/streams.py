"""Streaming queries over the driver's event table: each drains what is there and gives the result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlode.operators.bucketed import BucketTable
from eventlode.operators.upsert import upsert
from eventlode.plans.book import Book
from eventlode.sources import bind
from eventlode.streaming import ingest

BOOK = Book()


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(sf_dir + "/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + f"/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and returns what it wrote to the shared folder."""
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@BOOK.add("SELECT DISTINCT event_type, user_id FROM events", catalog=False)
def t03_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per kind and user: the data's days lie within the retention, so state holds all keys."""
    return drained(ingest.first_of_each(_stream(spark, sf_dir).select("ts", "event_type", "user_id"), ["event_type", "user_id"], retention="60 days")).select("event_type", "user_id")


@BOOK.add("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY 1, 2", catalog=False)
def t05_stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows that the watermark has closed."""
    out = drained(ingest.windowed_counts(_stream(spark, sf_dir), "event_type"))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("day"), "n")


@BOOK.add("""
, b AS (SELECT 0 AS k, event_id, venue_id, CASE WHEN event_id % 5 <> 0 THEN price END AS price, scrape_source AS source FROM ev WHERE event_id % 2 = 0
 UNION ALL SELECT 1, event_id, venue_id, CASE WHEN event_id % 7 <> 0 THEN price + 1 END, 'late' FROM ev WHERE event_id % 3 = 0
 UNION ALL SELECT 2, event_id, venue_id, price + 2, 'last' FROM ev WHERE event_id % 4 = 1 OR event_id % 10 = 0)
SELECT event_id, min_by(venue_id, k) AS venue_id, min_by(price, k) FILTER (price IS NOT NULL) AS price, min_by(source, k) AS source FROM b GROUP BY event_id""")
def t04_bucketed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deltas into a bucketed table, the second one twice; the last version after the older ones have expired."""
    ev = bind.catalog_events(spark, sf_dir)
    rows = lambda price, source: ev.select("event_id", "venue_id", price.alias("price"), source.alias("source"))
    first = rows(F.when(F.col("event_id") % 5 != 0, F.col("price")), F.col("scrape_source")).filter("event_id % 2 = 0")
    late = rows(F.when(F.col("event_id") % 7 != 0, F.col("price") + 1), F.lit("late")).filter("event_id % 3 = 0")
    last = rows(F.col("price") + 2, F.lit("last")).filter("event_id % 4 = 1 or event_id % 10 = 0")
    table = BucketTable(spark, shared_folder(spark), ["event_id"], buckets=16)
    for number, delta in ((0, first), (1, late), (1, late), (2, last)):
        table.apply(delta, lambda current, new: upsert(current, new, ["event_id"], backfill=["price"]).drop("change"), version=number)
    table.expire(keep=1)
    return table.read()

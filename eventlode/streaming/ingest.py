"""Streaming ingest: file sources, de-duplication within a watermark, upserts per micro-batch, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlode.operators.bucketed import BucketTable
from eventlode.operators.upsert import fold_delta, upsert


def run_log_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 4) -> DataFrame:
    """Rows of Parquet files as they land; the time column becomes a timestamp, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def first_of_each(stream: DataFrame, keys: list[str], time: str = "ts", retention: str = "7 days") -> DataFrame:
    """The first row of each key; a key is forgotten when the watermark passes its retention, which bounds the state."""
    return stream.withWatermark(time, retention).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, by: str, time: str = "ts", late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts per tumbling (or sliding) window; rows later than the watermark are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def session_counts(stream: DataFrame, by: str, time: str = "ts", late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def upsert_stream(stream: DataFrame, table_path: str, checkpoint: str, key: list[str], arrival: str, backfill: list[str], buckets: int = 64):
    """Upserts each micro-batch into a bucketed table, whose versions are the numbers of the batches; only buckets that a
    batch touches are rewritten, and a batch that is replayed changes nothing. The checkpoint and the table belong together.

    Returns the started query. version_of reads a version.
    """
    table = BucketTable(stream.sparkSession, table_path, key, buckets)

    def write(batch: DataFrame, number: int) -> None:
        table.apply(fold_delta(batch, key, arrival), lambda current, delta: upsert(current, delta, key, backfill=backfill).drop("change"), version=number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version_of(spark: SparkSession, table_path: str, number: int) -> DataFrame | None:
    """A version of the table, or None where there is none."""
    return BucketTable(spark, table_path, []).read(number)

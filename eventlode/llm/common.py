"""Pieces that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the cluster names none, one below the warehouse."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: smaller than a checkpoint of many small rows."""
    path = new_shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, parts: int = 1000) -> DataFrame:
    """Inner join of rows with keyed (one row per key) that does not gather a common key in one task.

    `weight` is a column of keyed: how many of the rows have the key. Keys of more than one in `parts` of all rows are
    fewer than `parts`, so these are broadcast; their rows take part in the shuffle of the others under keys of their own.
    """
    keyed = stored(keyed, "keys")
    total = keyed.agg(F.sum(weight).alias("_total"))
    values = [c for c in keyed.columns if c not in on and c != weight]
    marked = keyed.crossJoin(F.broadcast(total)).withColumn("_hot", F.col(weight) * parts > F.col("_total"))
    hot = marked.filter("_hot").select(*on, F.lit(True).alias("_is_hot"), *[F.col(c).alias(f"_h_{c}") for c in values])
    cold = marked.filter("not _hot").select(*on, F.lit(0).cast("long").alias("_salt"), F.lit(True).alias("_is_cold"), *values)
    others = [c for c in rows.columns if c not in on]
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_is_hot"), F.xxhash64(*others).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long")))
    both = salted.join(cold, [*on, "_salt"], "left").filter("_is_hot or _is_cold")
    return both.select(*on, *others, *[F.when(F.col("_is_hot"), F.col(f"_h_{c}")).otherwise(F.col(c)).alias(c) for c in values])


@contextmanager
def small_batches(spark: SparkSession, records: int = 1000) -> Iterator[None]:
    """Steps that run within get Arrow batches of at most so many rows: a batch of whole texts is held by Spark and by Python, several times while it grows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), records) if int(before) > 0 else records))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def sliced(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about `limit` bytes, so that few texts are Python objects at once."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % m

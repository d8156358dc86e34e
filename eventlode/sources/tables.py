"""CSV, JSON, gzip bundles and text lines as typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """Header row; a byte-order mark goes; names and values are trimmed, blank values are null, blank rows go."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.lstrip("﻿").strip().lower()) for c in df.columns])
    return df.dropna(how="all")


def json_rows(spark: SparkSession, path: str, wrapper: str, schema: str) -> DataFrame:
    """Rows of a JSON file that holds a list, or an object with the list under `wrapper`."""
    text = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.from_json(F.get_json_object("value", f"$.{wrapper}"), f"array<{schema}>"), F.from_json("value", f"array<{schema}>"))
    return text.select(F.inline(rows))


def bundle(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One list of a compressed JSON bundle; gzip is read as it is."""
    return spark.read.option("multiLine", True).json(path).select(F.inline(F.col(part)))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")

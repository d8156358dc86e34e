"""Validation of classified and extracted records: a clean record or the reason for its rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"


def classification(df: DataFrame, subs: DataFrame, parents: DataFrame) -> DataFrame:
    """df: artist, primary, secondary_1, secondary_2, confidence (text). subs, parents: one column `name` each.

    Adds reject_reason (null if kept) and fixed (whether something was put right). A verbose " Music" after a parent's
    name goes; a parent as primary becomes UNKNOWN of low confidence without secondaries; a parent as secondary goes.
    """
    labels = subs.select(F.col("name").alias("_n"), F.lit("sub").alias("_k")).union(parents.select("name", F.lit("parent"))).groupBy("_n").agg(F.max("_k").alias("_k"))  # sub before parent
    out = df
    for c in ("artist", "primary", "secondary_1", "secondary_2", "confidence"):
        out = out.withColumn(c, F.nullif(F.trim(F.col(c)), F.lit("")))
    for c in ("primary", "secondary_1", "secondary_2"):
        stem = F.when(F.col(c).endswith(" Music"), F.expr(f"substring({c}, 1, length({c}) - 6)"))
        out = out.withColumn(f"_s_{c}", stem)
        known = labels.filter("_k = 'parent'").select(F.col("_n").alias(f"_s_{c}"), F.lit(True).alias(f"_p_{c}"))
        out = out.join(known, f"_s_{c}", "left").withColumn(f"_x_{c}", F.coalesce(F.col(f"_p_{c}"), F.lit(False))).withColumn(c, F.when(F.col(f"_x_{c}"), F.col(f"_s_{c}")).otherwise(F.col(c))).drop(f"_s_{c}", f"_p_{c}")
        out = out.join(labels.select(F.col("_n").alias(c), F.col("_k").alias(f"_k_{c}")), c, "left")
    confidence = F.lower(F.coalesce("confidence", F.lit("")))
    unknown = F.upper("primary") == UNKNOWN
    parent = F.coalesce(F.col("_k_primary") == "parent", F.lit(False)) & ~unknown
    reason = (
        F.when(F.col("artist").isNull(), "missing artist")
        .when(F.col("primary").isNull(), "missing primary")
        .when(~confidence.isin("high", "medium", "low"), "invalid confidence")
        .when(unknown & (confidence != "low"), "unknown needs low confidence")
        .when(~unknown & F.col("_k_primary").isNull(), "primary not in taxonomy")
    )
    for c in ("secondary_1", "secondary_2"):
        reason = reason.when(~parent & (F.upper(c) == UNKNOWN), f"{c} may not be unknown").when(~parent & F.col(c).isNotNull() & F.col(f"_k_{c}").isNull(), f"{c} not in taxonomy")
    second = lambda c: F.when(~parent & (F.col(f"_k_{c}") == "sub"), F.col(c))
    fixed = parent | F.col("_x_primary") | F.col("_x_secondary_1") | F.col("_x_secondary_2") | F.coalesce(F.col("_k_secondary_1") == "parent", F.lit(False)) | F.coalesce(F.col("_k_secondary_2") == "parent", F.lit(False))
    return out.select("artist", F.when(unknown | parent, UNKNOWN).otherwise(F.col("primary")).alias("primary"), second("secondary_1").alias("secondary_1"), second("secondary_2").alias("secondary_2"), F.when(parent, "low").otherwise(confidence).alias("confidence"), reason.alias("reject_reason"), fixed.alias("fixed"))


def extracted(df: DataFrame, today: Column) -> DataFrame:
    """Keeps records with a name and a date that isn't over; prices that aren't numbers become null."""
    date = F.try_to_date(F.substring("start_date", 1, 10), "yyyy-MM-dd")
    return df.withColumn("start_date", date).withColumn("price", F.col("price").try_cast("double")).filter((F.trim("name") != "") & date.isNotNull() & (F.col("start_date") >= today))


def evidenced(name: Column, page: Column, length: int = 8) -> Column:
    """Whether the start of a name stands in the page, both lower-cased with spaces collapsed; an empty page proves nothing."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    return (flat(page) == "") | F.contains(flat(page), F.substring(flat(name), 1, length))

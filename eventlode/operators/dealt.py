"""Left joins whose rows without a key are spread over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_dealt(rows: DataFrame, other: DataFrame, key: str, by: str) -> DataFrame:
    """rows.join(other, key, "left"). Rows with a null key match nothing, but would all be sent to one task; here they are dealt by `by`.

    The joined key is an array: of the key alone, or of two parts for rows without one, which no key of `other` equals."""
    own = F.when(F.col(key).isNotNull(), F.array(F.col(key).cast("string"))).otherwise(F.array(F.lit(""), F.xxhash64(by).cast("string")))
    theirs = other.filter(F.col(key).isNotNull()).withColumn("_dealt", F.array(F.col(key).cast("string"))).drop(key)
    return rows.withColumn("_dealt", own).join(theirs, "_dealt", "left").drop("_dealt")

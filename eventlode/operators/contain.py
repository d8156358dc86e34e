"""Pairs of names of one group where one holds the other, by the rarest gram instead of all pairs.

If a name holds another, it holds each gram of it. So each name is looked for by its rarest gram of three characters only, among
the grams of all names of its group; what is found is then compared. Names shorter than that are looked for as a whole, which
is why grams of one and two characters are kept for groups that have such names.

Defined results: null names, keys and groups are in no pair; an empty name is in every other; names that are equal make a pair once;
a repeated key makes its pairs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3


def _grams(name: Column, size: Column | int) -> Column:
    """Distinct grams of `size` characters; none where the name is shorter."""
    n = F.length(name)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(size) if isinstance(size, int) else size))))


def containing_pairs(rows: DataFrame, key: Column, group: str, name: Column) -> DataFrame:
    """group, holder, held: keys (any ordered type) of each pair; of equal names the holder is the smaller key."""
    own = rows.select(F.col(group).alias("_g"), key.alias("_id"), name.alias("_k"))
    own = own.filter(F.col("_g").isNotNull() & F.col("_id").isNotNull() & F.col("_k").isNotNull())
    long = own.filter(F.length("_k") >= SIZE).select("_g", "_id", "_k", F.explode(_grams(F.col("_k"), SIZE)).alias("_q"))
    counts = long.groupBy("_g", "_q").agg(F.count(F.lit(1)).alias("_n"))
    rarest = long.join(counts, ["_g", "_q"]).groupBy("_g", "_id", "_k").agg(F.min(F.struct("_n", "_q"))["_q"].alias("_q"))
    # rows of one id and name are one group above: copies come back by their number
    copies = own.groupBy("_g", "_id", "_k").agg(F.count(F.lit(1)).alias("_m"))
    wanted = rarest.join(copies, ["_g", "_id", "_k"]).select("_g", "_q", F.col("_id").alias("held"), F.col("_k").alias("_kb"), "_m")
    short = copies.filter(F.length("_k") < SIZE).select("_g", F.col("_k").alias("_q"), F.col("_id").alias("held"), F.col("_k").alias("_kb"), "_m")
    groups = short.select("_g", F.length("_q").alias("_l")).distinct()
    parts = own.join(groups, "_g").select("_g", "_id", "_k", F.explode(F.when(F.col("_l") == 0, F.array(F.lit(""))).otherwise(_grams(F.col("_k"), F.col("_l")))).alias("_q"))
    sides = long.unionByName(parts).select("_g", "_q", F.col("_id").alias("holder"), F.col("_k").alias("_ka"))
    found = sides.join(wanted.unionByName(short), ["_g", "_q"]).filter(F.col("_ka").contains(F.col("_kb")) & ((F.col("_ka") != F.col("_kb")) | (F.col("holder") < F.col("held"))))
    return found.select(F.col("_g").alias(group), "holder", "held", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias("_i")).drop("_i")

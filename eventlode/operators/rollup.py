"""Mergeable exact distinct counts: bitmaps of ids per day, united over any days.

A rollup has one row per day, group, kind of id and block of 64 ids, with the bits of those that occur as one number. Built once a day
from that day's rows only, it answers distinct counts over any span of days by or-ing; nothing is counted twice where an id comes on
several days. A rollup has at most one row per id that occurs on a day, however far ids lie apart: with large blocks a day's ids, scattered
over ever more of them as the table grows, would each carry a bitmap of nearly nothing.

Null ids and null days take no part; a null group is a group. Ids are whole numbers, best dense ones.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block has two to this power ids, the bits of a long.
BLOCK_BITS = 6


def daily(rows: DataFrame, day: str, groups: list[str], ids: Mapping[str, str | Column]) -> DataFrame:
    """day, groups, kind, block, bitmap: the ids of each kind (name to column) that occur on each day."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(c) if isinstance(c, str) else c).cast("long").alias("id")) for k, c in ids.items()])
    each = rows.select(F.col(day).alias("day"), *groups, F.inline(kinds)).filter(F.col("day").isNotNull() & F.col("id").isNotNull())
    bit = F.expr(f"shiftleft(1L, cast(id & {2**BLOCK_BITS - 1} as int))")
    placed = each.select("day", *groups, "kind", F.shiftright("id", BLOCK_BITS).alias("block"), bit.alias("bit"))
    return placed.groupBy("day", *groups, "kind", "block").agg(F.bit_or("bit").alias("bitmap"))


def added(rollup: DataFrame, later: DataFrame) -> DataFrame:
    """A rollup with the rows of another one: days that both have are united."""
    key = [c for c in rollup.columns if c != "bitmap"]
    return rollup.unionByName(later).groupBy(*key).agg(F.bit_or("bitmap").alias("bitmap"))


def distinct_in(rollup: DataFrame, spans: Mapping[str, Column], groups: list[str]) -> DataFrame:
    """groups, kind, and for each span (name to condition on `day`) the number of distinct ids, in one pass over the rollup.

    Groups of the rollup that are not named are united. A span without rows counts 0."""
    united = rollup.groupBy(*groups, "kind", "block").agg(*[F.bit_or(F.when(on, F.col("bitmap"))).alias(name) for name, on in spans.items()])
    return united.groupBy(*groups, "kind").agg(*[F.coalesce(F.sum(F.bit_count(name)), F.lit(0)).cast("long").alias(name) for name in spans])

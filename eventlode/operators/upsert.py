"""Writes as pure functions: current rows and a delta in, new rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlode.functions.text import blank
from eventlode.operators.landed import landed


def upsert(current: DataFrame, delta: DataFrame, key: list[str], backfill: list[str] = (), overwrite: list[str] = ()) -> DataFrame:
    """Full outer join on the key. Matched rows take delta values for `overwrite` where it has one, and for `backfill`
    where the current value is blank; other columns of matched rows stay. Adds `change`: inserted, updated or same.

    The delta has one row per key (fold_delta). A null in the key matches nothing.
    """
    columns = [c for c in current.columns if c not in key]
    a, b = current.withColumn("_a", F.lit(True)).alias("a"), delta.withColumn("_b", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full")
    old, new = F.col("_a").isNotNull(), F.col("_b").isNotNull()

    def value(c: str) -> Column:
        mine, theirs = F.col(f"a.{c}"), F.col(f"b.{c}") if c in delta.columns else F.lit(None)
        if c in overwrite:
            both = F.coalesce(theirs, mine)
        elif c in backfill:
            both = F.when(blank(mine.cast("string")), theirs).otherwise(mine)
        else:
            both = mine
        return F.when(old & new, both).when(old, mine).otherwise(theirs)

    touched = [c for c in columns if c in delta.columns and (c in overwrite or c in backfill)]
    changed = F.lit(False)
    for c in touched:
        changed = changed | ~value(c).eqNullSafe(F.col(f"a.{c}"))
    kind = F.when(~old, "inserted").when(new & changed, "updated").otherwise("same")
    kind = F.when(F.coalesce(old, F.lit(False)), kind).otherwise("inserted")
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], *[value(c).alias(c) for c in columns], kind.alias("change"))


def fold_delta(delta: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """One row per key: the first to arrive, its missing values from the next that has them."""
    rest = [c for c in delta.columns if c not in (*key, arrival)]
    ordered = F.array_sort(F.collect_list(F.struct(arrival, *rest)))
    rows = delta.dropna(subset=key).groupBy(*key).agg(ordered.alias("_rows"))
    return rows.select(*key, *[F.get(F.filter(F.col("_rows").getField(c), lambda x: x.isNotNull()), F.lit(0)).alias(c) for c in rest])


def insert_absent(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return current.unionByName(new.join(current.select(*key), key, "left_anti"), allowMissingColumns=True)


def numbered(new: DataFrame, current: DataFrame, id_col: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """Ids for new rows: the largest id so far plus the row's rank in natural order.

    Ranks come from row numbers within ranges of the first order column and counts of the ranges before, so no
    task sees all rows.
    """
    top = current.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    # both uses must see the same ranges, which are drawn from a sample: one relation in the shared folder gives them
    spread = (ranges, *order) if ranges else order
    ranged = landed(new.repartitionByRange(*spread).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy(*order)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranks = ranged.withColumn("_r", F.row_number().over(own)).join(before, "_part").crossJoin(F.broadcast(top))
    return ranks.withColumn(id_col, (F.col("_top") + F.col("_o") + F.col("_r")).cast("long")).drop("_part", "_r", "_o", "_top")


def find_or_create(current: DataFrame, wanted: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """All rows after creating those of `wanted` whose key is new."""
    new = wanted.select(*key).dropna().distinct().join(current.select(*key), key, "left_anti")
    return current.unionByName(numbered(new, current, id_col, key), allowMissingColumns=True)


def expired(df: DataFrame, date: str, before: Column) -> DataFrame:
    """What stays after a retention delete."""
    return df.filter(F.col(date) >= before)


def stale_runs(runs: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    late = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return runs.withColumn("notes", F.when(late, F.concat(F.coalesce("notes", F.lit("")), F.lit(" (stale)"))).otherwise(F.col("notes"))).withColumn("status", F.when(late, "stale").otherwise(F.col("status")))

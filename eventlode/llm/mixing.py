"""Mixing sources to target weights by proportional-fair scheduling.

The rows of a source, in the order of a digest of their ids, are cut into blocks. In a period of P
slots a source of whole weight w has w blocks; block k is released at floor(k * P / w) and due at
ceil((k + 1) * P / w). Among released blocks the one with the earliest deadline takes each slot, so
after any number of slots each source is less than one block from its share. The schedule of one
period depends on the weights only and repeats; a source that has run out leaves its slots empty.

Every row is kept exactly once. Ranks come from counts per (source, digest prefix) and a row number
within such a bucket, so a source that holds a third of all rows spreads over many tasks. The table of
sources is held in one row: it suits thousands of sources, not millions.

Defined results: a null source counts as the empty source; a null id sorts first by an empty digest;
repeated ids take neighbouring places, ordered by the kept columns; an empty table gives an empty result; other columns
are ignored; kept ones may have any names.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, RESOLUTION, MOST_SLOTS = 64, 1000, 100_000


def whole_weights(targets: dict[str, float], most_slots: int = MOST_SLOTS) -> dict[str, int]:
    """Whole numbers in exactly the ratios of the targets; a ValueError if their period has more than `most_slots` slots."""
    parts = {k: Fraction(str(v)) for k, v in targets.items() if v > 0}
    if not parts:
        return {}
    scale = math.lcm(*[p.denominator for p in parts.values()])
    whole = {k: int(p * scale) for k, p in parts.items()}
    common = math.gcd(*whole.values())
    whole = {k: w // common for k, w in whole.items()}
    if sum(whole.values()) > most_slots:
        raise ValueError(f"the targets need a period of {sum(whole.values())} slots; at most {most_slots} are allowed, so give them with fewer digits")
    return whole


def _with(value: Column, use) -> Column:
    """use(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def period(weights: DataFrame) -> DataFrame:
    """weights: src, w (long). The schedule of one period: src, k, w, slot, period_slots.

    Slots are taken in runs of about the square root of the period, so the list of slots is not copied once per slot.
    """
    one = weights.agg(F.sort_array(F.collect_list(F.struct("src", "w"))).alias("s"), F.sum("w").alias("p")).filter(F.col("p") > 0)
    run = F.ceil(F.sqrt(F.col("p").cast("double"))).cast("long")
    nothing = F.expr("cast(array() as array<struct<i:int,k:bigint>>)")

    def step(acc: Column, t: Column) -> Column:
        jobs = F.transform(
            "s",
            lambda x, i: F.when(
                (F.get(acc["n"], i) < x["w"]) & (F.get(acc["n"], i) * F.col("p") <= t * x["w"] + (x["w"] - 1)),
                F.struct(F.ceil((F.get(acc["n"], i) + 1) * F.col("p") / x["w"]).alias("d"), i.alias("i")),
            ),
        )
        return F.struct(acc["n"].alias("n"), F.array_min(jobs)["i"].alias("i"), acc["out"].alias("out"))

    def take(acc: Column) -> Column:
        return F.struct(
            F.transform(acc["n"], lambda n, i: F.when(i == acc["i"], n + 1).otherwise(n)).alias("n"),
            acc["i"].alias("i"),
            F.concat(acc["out"], F.array(F.struct(acc["i"].alias("i"), F.get(acc["n"], acc["i"]).alias("k")))).alias("out"),
        )

    def slots_of(acc: Column, at: Column) -> Column:
        fresh = F.struct(acc["n"].alias("n"), acc["i"].alias("i"), nothing.alias("out"))
        some = F.aggregate(F.sequence(at, F.least(at + F.col("_run"), F.col("p")) - 1), fresh, lambda a, t: _with(step(a, t), take))
        return _with(some, lambda x: F.struct(x["n"].alias("n"), x["i"].alias("i"), F.concat(acc["out"], x["out"]).alias("out")))

    start = F.struct(F.transform("s", lambda _: F.lit(0).cast("long")).alias("n"), F.lit(0).cast("int").alias("i"), nothing.alias("out"))
    runs = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("p") - 1) / F.col("_run"))), lambda r: r * F.col("_run"))
    done = one.withColumn("_run", run).select("s", "p", F.aggregate(runs, start, slots_of)["out"].alias("out"))
    slots = done.select("s", "p", F.posexplode("out").alias("slot", "j"))
    return slots.select(F.get("s", F.col("j.i"))["src"].alias("src"), F.col("j.k").alias("k"), F.get("s", F.col("j.i"))["w"].alias("w"), F.col("slot").cast("long").alias("slot"), F.col("p").alias("period_slots"))


def mix(df: DataFrame, id_col: str = "doc_id", source: str = "source", targets: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, resolution: int = RESOLUTION, keep: list[str] | None = None) -> DataFrame:
    """id, source, source_rank, block, slot, in_block, and the columns `keep`. Order by (slot, in_block) to read the mix.

    targets: weight by source, taken exactly as given (whole_weights); sources without one come after the last slot of
    the others, in turns. Without targets a source's target is its share of the square roots of all sources' rows, which
    lifts small sources, in whole parts of `resolution`, one at least.
    """
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(source), F.lit("")).alias("src"),
        F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit("")).alias("_d"),
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep or [])],
    ).withColumn("_b", F.substring("_d", 1, 3))
    counts = rows.groupBy("src", "_b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("_o", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("src", "_b", "_o")
    totals = counts.groupBy("src").agg(F.sum("n").alias("n"))
    if targets is None:
        share = totals.withColumn("v", F.sqrt(F.col("n").cast("double")))
        total = share.agg(F.array_sort(F.collect_list("v")).alias("vs")).select(F.aggregate("vs", F.lit(0.0), lambda a, x: a + x).alias("v_all"))
        weights = share.crossJoin(F.broadcast(total)).select("src", F.greatest(F.lit(1), F.floor(F.lit(resolution) * F.col("v") / F.when(F.col("v_all") > 0, F.col("v_all")).otherwise(1.0) + 0.5)).cast("long").alias("w"))
    else:
        whole = whole_weights(targets)
        given = F.create_map(*[F.lit(x) for kv in whole.items() for x in kv])[F.col("src")].cast("long") if whole else F.lit(None).cast("long")
        weights = totals.select("src", given.alias("w")).filter("w is not null")
        later = totals.select("src", F.when(given.isNull(), 1).cast("long").alias("w")).filter("w is not null")
    schedule = period(weights).withColumn("later", F.lit(False))
    if targets is not None:
        schedule = schedule.union(period(later).withColumn("later", F.lit(True)))
    sizes = schedule.select("src", "w", "period_slots", "later").distinct()
    # the slots that the weighted sources take; the others follow them
    taken = totals.join(sizes.filter("not later"), "src").agg(F.coalesce(F.max((F.floor((F.ceil(F.col("n") / block_rows) - 1) / F.col("w")) + 1) * F.col("period_slots")), F.lit(0)).cast("long").alias("taken"))
    ties = [f"_k{i}" for i, c in enumerate(keep or []) if df.schema[c].dataType.typeName() not in ("map", "variant")]
    place = Window.partitionBy("src", "_b").orderBy("_d", "_id", *ties)
    ranked = rows.withColumn("_r", F.row_number().over(place) - 1).join(before, ["src", "_b"]).withColumn("source_rank", (F.col("_r") + F.col("_o")).cast("long"))
    blocks = ranked.withColumn("block", F.floor(F.col("source_rank") / block_rows)).join(sizes, "src").withColumn("k", F.col("block") % F.col("w"))
    out = blocks.join(schedule.select("src", "k", F.col("slot").alias("_slot")), ["src", "k"])
    slot = F.floor(F.col("block") / F.col("w")) * F.col("period_slots") + F.col("_slot")
    if targets is not None:
        out, slot = out.crossJoin(F.broadcast(taken)), slot + F.when(F.col("later"), F.col("taken")).otherwise(0)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("src").alias(source),
        "source_rank",
        "block",
        slot.alias("slot"),
        (F.col("source_rank") % block_rows).alias("in_block"),
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep or [])],
    )


def oracle(docs: str = "documents") -> str:
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY coalesce(md5(doc_id::VARCHAR), ''), doc_id) - 1 AS source_rank FROM {docs}),
    v AS (SELECT source, sqrt(count(*)::DOUBLE) AS v FROM d GROUP BY 1),
    a AS (SELECT list_reduce(list(v ORDER BY v), lambda x, y: x + y) AS va FROM v),
    w AS (SELECT source, greatest(1, floor({RESOLUTION} * v / va + 0.5)::BIGINT) AS w, row_number() OVER (ORDER BY source) AS i FROM v, a),
    g AS (SELECT list(w ORDER BY i) AS ws, sum(w)::BIGINT AS p, count(*) AS m FROM w),
    e(t, n, j) AS (
      SELECT 0::BIGINT, list_transform(ws, lambda x: 0::BIGINT), NULL::BIGINT FROM g
      UNION ALL
      SELECT t + 1, list_transform(n, lambda x, i: x + (i = b)::BIGINT), b FROM (
        SELECT t, n, p, list_min(list_filter(list_transform(ws, lambda x, i: CASE WHEN n[i] < x AND n[i] * p // x <= t THEN {{'d': ((n[i] + 1) * p + x - 1) // x, 'i': i}} END), lambda y: y IS NOT NULL)).i::BIGINT AS b
        FROM e, g WHERE t < p)),
    s AS (SELECT t - 1 AS slot, j, row_number() OVER (PARTITION BY j ORDER BY t) - 1 AS k FROM e WHERE j IS NOT NULL)
    SELECT doc_id, d.source, source_rank::BIGINT AS source_rank, (source_rank // {BLOCK_ROWS})::BIGINT AS block,
      ((source_rank // {BLOCK_ROWS}) // w.w * p + s.slot)::BIGINT AS slot, (source_rank % {BLOCK_ROWS})::BIGINT AS in_block
    FROM d JOIN w USING (source), g JOIN s ON s.j = w.i AND s.k = (source_rank // {BLOCK_ROWS}) % w.w"""

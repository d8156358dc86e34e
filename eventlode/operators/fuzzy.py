"""Pairs of resembling names within blocks, found by joins on rare letter pairs, and what depends on such pairs.

The ratio of two names of lengths m and n is 2M / (m + n), M letters lying in matching blocks. Between two blocks at
least one letter is unmatched, so there are at most 1 + (m + n - 2M) blocks, and the names share at least
M - blocks = 3M - 1 - (m + n) letter pairs: over (1.5 t - 1)(m + n) - 1 of them if the ratio is over t. Of two sets with so large an
overlap the rarest members meet, so a name is joined by its rarest letter pairs only (a prefix of its sorted list), to names of
fitting length. No pair is lost for t of 0.8 or more. Pairs are dealt out by letter pair, so a block that holds many
of the rows spreads over many tasks.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from eventlode.operators import similarity
from eventlode.operators.landed import landed, shared_folder
from eventlode.operators.similarity import seq_ratio

LEAST = 0.8


@pandas_udf(ArrayType(StringType()))
def letter_pairs(s: pd.Series) -> pd.Series:
    """Pairs of neighbouring letters, repeated ones told apart by their number."""

    def own(text: str) -> list[str]:
        seen: Counter = Counter()
        out = []
        for i in range(len(text) - 1):
            pair = text[i : i + 2]
            seen[pair] += 1
            out.append(pair if seen[pair] == 1 else f"{pair}{seen[pair]}")
        return out

    return pd.Series([own(x or "") for x in s], dtype="object")


def needed(length: int, least: float) -> int:
    """How many of its `length` - 1 letter pairs a name has to take part with."""
    shortest = 2 * length / (2 - least)  # the sum of both lengths, at least
    overlap = max(1, math.floor((1.5 * least - 1) * shortest - 1 - 1e-6) + 1)
    return max(1, length - 1 - overlap + 1)


def _needed(least: float):
    return pandas_udf(lambda n: n.map(lambda x: needed(int(x), least)).astype("int32"), IntegerType())


def settled(df: DataFrame) -> DataFrame:
    """The rows, cut from their lineage in the shared folder."""
    sc, spark = df.sparkSession.sparkContext, df.sparkSession
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def alike(names: DataFrame, block: list[str], name: str, least: float) -> DataFrame:
    """block columns, a, b (a < b), ab, ba: different names of a block of which one resembles the other by more than `least`.

    ab: the ratio of a to b, which may differ from that of b to a, is over `least`. Block columns and names without nulls.
    """
    if least < LEAST:
        raise ValueError(f"no ratio below {LEAST}: resembling names may then share no letter pair")
    own = names.select(*block, F.col(name).alias("a")).distinct().withColumn("n", F.length("a")).filter("n > 1")
    pairs = settled(own.select(*block, "a", "n", F.explode(letter_pairs("a")).alias("g")))
    often = pairs.groupBy(*block, "g").agg(F.count(F.lit(1)).alias("f"))
    listed = pairs.join(often, [*block, "g"]).groupBy(*block, "a", "n").agg(F.sort_array(F.collect_list(F.struct("f", "g"))).alias("l"))
    rare = listed.select(*block, "a", "n", F.explode(F.slice("l", F.lit(1), _needed(least)("n"))).alias("p")).filter("p.f > 1").select(*block, "a", "n", F.col("p.g").alias("g"))
    other = rare.select(*block, F.col("a").alias("b"), F.col("n").alias("m"), "g")
    fits = 2 * F.least("n", "m") > F.lit(least) * (F.col("n") + F.col("m"))
    met = rare.join(other, [*block, "g"]).filter((F.col("a") < F.col("b")) & fits).select(*block, "a", "b").distinct()
    rated = met.withColumn("ab", seq_ratio("a", "b") > least).withColumn("ba", seq_ratio("b", "a") > least)
    return rated.filter("ab or ba")


def parts(links: DataFrame) -> DataFrame:
    """links: a, b (long). id, part (smallest id connected to it) of all linked ids, by least neighbours and pointer jumps."""
    edges = settled(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = settled(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("part")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("part").alias("m"))
        step = labels.join(near, "id").select("id", F.col("part").alias("was"), F.least("part", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("part").alias("j"))
        new = settled(step.join(jump, "c", "left").select("id", "was", F.least("c", F.coalesce("j", "c")).alias("part")))
        labels = new.select("id", "part")
        if new.filter("part <> was").isEmpty():
            return labels


def _key(block: list[str], name: str):
    return F.xxhash64(*[F.col(c).cast("string") for c in block], name)


def _linked(pairs: DataFrame, block: list[str]) -> tuple[DataFrame, DataFrame]:
    """From alike(): (part, x, y) for every x that resembles y, keyed by names' hashes, and (key, part) of all linked names.

    A hash is of block and name. Two names that share one would be in one part together, where the names themselves decide.
    """
    keyed = settled(pairs.withColumn("ka", _key(block, "a")).withColumn("kb", _key(block, "b")))
    of = parts(keyed.select(F.col("ka").alias("a"), F.col("kb").alias("b"))).withColumnRenamed("id", "ka")
    both = keyed.join(of, "ka")
    ways = both.filter("ab").select("part", F.col("a").alias("x"), F.col("b").alias("y")).union(both.filter("ba").select("part", F.col("b").alias("x"), F.col("a").alias("y")))
    return ways, of.withColumnRenamed("ka", "key")


def _resembled(ways: pd.DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for x, y in zip(ways["x"], ways["y"], strict=True):
        out.setdefault(x, []).append(y)
    return out


def greedy_clusters(df: DataFrame, block: list[str], id_col: str, name: str, least: float = LEAST) -> DataFrame:
    """block columns, id, cluster (smallest id of it). In id order each row joins the first cluster with a member
    that it resembles by more than `least`, or opens one; clusters never merge. Rows with a null block column stay alone.

    A name that resembles no other is one cluster, found by a minimum. Order matters only within connected parts of resembling names, and
    only those go through Python, a part at a time: its rows are ids and names.
    """
    rows = df.select(*block, F.col(id_col).cast("long").alias("_id"), F.lower(F.coalesce(F.col(name), F.lit(""))).alias("_name"))
    some = rows.dropna(subset=block).withColumn("key", _key(block, "_name"))
    names = some.groupBy(*block, "_name", "key").agg(F.min("_id").alias("_first"))
    ways, of = _linked(alike(names, block, "_name", least), block)
    single = some.join(names.join(of, "key", "left_anti").select(*block, "_name", "_first"), [*block, "_name"]).select("_id", F.col("_first").alias("cluster"))

    def cluster(part: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_id")
        resembled, lowest, heads, out = _resembled(ways), {}, [], []
        for i, text in zip(part["_id"], part["_name"], strict=True):
            met = [lowest[y] for y in (text, *resembled.get(text, ())) if y in lowest]
            if not met:
                heads.append(i)
            at = min(met) if met else len(heads) - 1
            lowest[text] = min(at, lowest.get(text, at))
            out.append(heads[at])
        return pd.DataFrame({"_id": part["_id"], "cluster": out})

    linked = some.join(of, "key").select(F.col("part").alias("own"), "_id", "_name")
    many = linked.groupBy("own").cogroup(ways.groupBy("part")).applyInPandas(cluster, "_id long, cluster long")
    found = single.union(many)
    return rows.join(found, "_id", "left").select(*block, F.col("_id").alias(id_col), F.coalesce("cluster", "_id").alias("cluster"))


def survivors(df: DataFrame, block: list[str], order: str, name: str, is_new: str, least: float = 0.85) -> DataFrame:
    """order of the new rows that are kept: in order, a new row goes if its name resembles by more than `least` that of a stored
    row of its block or of a new row kept before; rows that went don't count. Rows with a blank block column are all kept.

    Of equal names the first new row decides for all. A name that is stored, or resembles one that is, goes; of the
    others only connected parts of resembling names depend on order, a row per name.
    """
    rows = df.select(*block, F.col(order).cast("long").alias("_o"), F.lower(F.coalesce(F.col(name), F.lit(""))).alias("_name"), F.col(is_new).cast("boolean").alias("_new"))
    known = F.lit(True)
    for c in block:
        known = known & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    names = settled(rows.filter(known).groupBy(*block, "_name").agg(F.min("_o").alias("_o"), F.min("_new").alias("_new")).withColumn("key", _key(block, "_name")))
    busy = names.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.max("_new").alias("_any")).filter("_n > 1 and _any").select(*block)
    pairs = settled(alike(names.join(busy, block, "left_semi"), block, "_name", least))
    ways = pairs.filter("ab").select(*block, F.col("a").alias("_name"), F.col("b").alias("y")).union(pairs.filter("ba").select(*block, F.col("b").alias("_name"), F.col("a").alias("y")))
    stored = names.filter("not _new").select(*block, F.col("_name").alias("y"))
    gone = ways.join(stored, [*block, "y"], "left_semi").select(*block, "_name")
    open_ = settled(names.filter("_new").join(gone.distinct(), [*block, "_name"], "left_anti"))
    mine = open_.select(*block, F.col("_name").alias("a"))
    left = pairs.join(mine, [*block, "a"], "left_semi").join(mine.withColumnRenamed("a", "b"), [*block, "b"], "left_semi")
    new_ways, of = _linked(left, block)

    def keep(part: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        resembled, kept, out = _resembled(ways), set(), []
        for o, text in part.sort_values("_o")[["_o", "_name"]].itertuples(index=False):
            if not any(y in kept for y in resembled.get(text, ())):
                kept.add(text)
                out.append(o)
        return pd.DataFrame({"_o": pd.Series(out, dtype="int64")})

    compared = open_.join(of, "key").select(F.col("part").alias("own"), "_o", "_name").groupBy("own").cogroup(new_ways.groupBy("part")).applyInPandas(keep, "_o long")
    alone = open_.join(of, "key", "left_anti").select("_o")
    free = rows.filter(~known & F.col("_new")).select("_o")
    return compared.union(alone).union(free).withColumnRenamed("_o", order)


#: Names that a block may have to be compared whole in one task.
SMALL_BLOCK = 200


def _split(df: DataFrame, block: list[str], name: str, most: int) -> DataFrame | None:
    """The blocks with more than `most` different names, or None if there are none."""
    # few blocks have so many rows, and only those are looked through for different names
    full = df.dropna(subset=block).groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*block)
    names = df.join(full, block, "left_semi").select(*block, F.lower(F.coalesce(F.col(name), F.lit(""))).alias("_name")).distinct()
    large = settled(names.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*block))
    return None if large.isEmpty() else large


def clustered(df: DataFrame, block: list[str], id_col: str, name: str, least: float = LEAST, most: int = SMALL_BLOCK) -> DataFrame:
    """greedy_clusters by the way that fits each block: whole in one task up to `most` names, by pairs beyond."""
    large = _split(df, block, name, most) if least >= LEAST else None
    if large is None:
        return similarity.greedy_clusters(df, block, id_col, name, least)
    small = df.join(large, block, "left_anti")
    return similarity.greedy_clusters(small, block, id_col, name, least).union(greedy_clusters(df.join(large, block, "left_semi"), block, id_col, name, least))


def surviving(df: DataFrame, block: list[str], order: str, name: str, is_new: str, least: float = 0.85, most: int = SMALL_BLOCK) -> DataFrame:
    """survivors by the way that fits each block: whole in one task up to `most` names, by pairs beyond."""
    df = landed(df.select(*block, order, name, is_new))
    large = _split(df, block, name, most) if least >= LEAST else None
    if large is None:
        return similarity.survivors(df, block, order, name, is_new, least)
    small = df.join(large, block, "left_anti")
    return similarity.survivors(small, block, order, name, is_new, least).union(survivors(df.join(large, block, "left_semi"), block, order, name, is_new, least))

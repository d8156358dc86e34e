"""String similarity that Spark lacks, as Arrow-batched functions, and greedy clustering within blocks."""

from __future__ import annotations

from difflib import SequenceMatcher
from unicodedata import combining, normalize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


@pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of a to b; the order of the arguments matters. Null with a null side."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(StringType())
def unaccented(s: pd.Series) -> pd.Series:
    """Lower case without combining marks, spaces collapsed."""
    return pd.Series([None if x is None else " ".join("".join(c for c in normalize("NFKD", x) if not combining(c)).lower().split()) for x in s], dtype="object")


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Lengths alone allow the ratio: a cheap test to put before the function."""
    return 2 * F.least(F.length(a), F.length(b)) > F.lit(least) * (F.length(a) + F.length(b))


def may_share(a: Column, b: Column, least: float) -> Column:
    """Enough of the letters of a, each as often as it comes, have one that b holds anywhere: a bound of the ratio that needs no Python."""
    shared = F.length(a) - F.length(F.call_function("translate", a, b, F.lit("")))
    return 2 * shared > F.lit(least) * (F.length(a) + F.length(b))


def greedy_clusters(df: DataFrame, block: list[str], id_col: str, name: str, least: float = 0.80) -> DataFrame:
    """block columns, id, cluster (smallest id of it). In id order each row joins the first cluster with a member
    that it resembles by more than `least`, or opens one; clusters never merge. Blocks are venue and day: small by
    nature. Rows with a null block column stay alone. Only blocks of two rows or more go through Python.
    """
    rows = df.select(*block, F.col(id_col).cast("long").alias("_id"), F.lower(F.coalesce(F.col(name), F.lit(""))).alias("_name"))
    some = rows.dropna(subset=block)
    crowded = some.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        found: list[list[str]] = []
        heads: list[int] = []
        out = []
        for i, text in zip(pdf["_id"], pdf["_name"], strict=True):
            for k, members in enumerate(found):
                if any(2 * min(len(text), len(m)) >= least * (len(text) + len(m)) and SequenceMatcher(None, text, m).ratio() > least for m in members):
                    members.append(text)
                    out.append(heads[k])
                    break
            else:
                found.append([text])
                heads.append(i)
                out.append(i)
        return pd.DataFrame({"_id": pdf["_id"], "cluster": out})

    many = some.join(crowded, block, "left_semi").groupBy(*block).applyInPandas(cluster, "_id long, cluster long")
    return rows.join(many, "_id", "left").select(*block, F.col("_id").alias(id_col), F.coalesce("cluster", "_id").alias("cluster"))


def survivors(df: DataFrame, block: list[str], order: str, name: str, is_new: str, least: float = 0.85) -> DataFrame:
    """order of the new rows that are kept: in order, a new row goes if its name resembles by more than `least` that of a stored
    row of its block or of a new row kept before; rows that went don't count. Rows with a blank block column are all kept.

    Equal names are grouped before a block reaches Python: the first of a new name decides for all, and a name that is
    stored settles it, so only blocks with two different names are compared.
    """
    rows = df.select(*block, F.col(order).alias("_o"), F.lower(F.coalesce(F.col(name), F.lit(""))).alias("_name"), F.col(is_new).cast("boolean").alias("_new"))
    known = F.lit(True)
    for c in block:
        known = known & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    names = rows.filter(known).groupBy(*block, "_name").agg(F.min("_o").alias("_o"), F.min("_new").alias("_new"))
    busy = names.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.max("_new").alias("_any")).filter("_n > 1 and _any").select(*block)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[str] = []
        out = []
        for o, text, new in pdf.sort_values(["_new", "_o"])[["_o", "_name", "_new"]].itertuples(index=False):
            like = new and any(2 * min(len(text), len(m)) >= least * (len(text) + len(m)) and SequenceMatcher(None, text, m).ratio() > least for m in kept)
            if not like:
                kept.append(text)
                if new:
                    out.append(o)
        return pd.DataFrame({"_o": pd.Series(out, dtype="int64")})

    compared = names.join(busy, block, "left_semi").groupBy(*block).applyInPandas(keep, "_o long")
    alone = names.join(busy, block, "left_anti").filter("_new").select(F.col("_o").cast("long"))
    free = rows.filter(~known & F.col("_new")).select(F.col("_o").cast("long"))
    return compared.union(alone).union(free).withColumnRenamed("_o", order)

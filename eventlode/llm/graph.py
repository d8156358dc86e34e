"""Connected components as joins, with the labels cut from their lineage each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlode.llm.common import cut

#: Links that one task holds well.
ROWS_A_TASK = 200_000


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a, b (long). Returns id, class_id (the smallest id of its component) for every linked id.

    Each round takes the smallest label among the neighbours and then the label of that label, so a
    chain of n links takes about log(n) rounds; stars take two.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    tasks = 1 + edges.count() // ROWS_A_TASK  # few links are few files a round
    edges = edges.coalesce(tasks)
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("class_id")).coalesce(tasks))
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("id").alias("b"), "class_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("m"))
        step = labels.join(near, "id").select("id", F.col("class_id").alias("was"), F.least("class_id", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("class_id").alias("j"))
        labels_ = cut(step.join(jump, "c", "left").select("id", "was", F.least("c", F.coalesce("j", "c")).alias("class_id")).coalesce(tasks))
        done = labels_.filter("class_id <> was").isEmpty()
        labels = labels_.select("id", "class_id")
        if done:
            return labels
    raise RuntimeError("components did not settle")

"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (u, v); label: the least node that can be reached.

    Each round takes the least label of the neighbours and then follows labels of labels, so the
    rounds grow with the logarithm of the longest path. Every round is written to the shared
    folder; an empty table gives an empty table.
    """
    both = stage(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("seen")), "v").groupBy("u").agg(F.min("seen").alias("seen"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stage(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = after.where(F.col("label") != F.col("old")).limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels

"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loadweave.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) links; the component's name is its smallest node.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    chains shorten by powers of two. Labels are stored every round; only a count comes to the driver.
    """
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near"))).where("node <> near").distinct())
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("component")))
    while True:
        of_near = labels.select(F.col("node").alias("near"), F.col("component").alias("theirs"))
        least = both.join(of_near, "near").groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = stored(labels.join(least, "node").select("node", F.col("component").alias("before"), F.least("component", "theirs").alias("component")))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = stored(step.join(jump, "component", "left").select("node", "before", F.least("component", F.coalesce("further", "component")).alias("component")))
        if labels.where("component <> before").isEmpty():
            return labels.select("node", "component")

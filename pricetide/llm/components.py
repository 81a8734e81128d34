"""Connected components of a link table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the component is its smallest node.

    Each round a node takes the smallest label among its neighbours' and its own, and then its label's label, so a
    chain shrinks by doubling steps. Labels are written between rounds; nothing but a count reaches the driver.
    """
    both = materialize(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
        "node", F.least("node", "near").alias("component")))
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = materialize(stepped.join(roots, "component", "left").select(
            "node", "was", F.least("component", "root").alias("component")))
        labels = new.select("node", "component")
        if new.filter("was != component").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")

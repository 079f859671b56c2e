"""Connected components by spreading the smallest label, with jumps along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.llm.shared import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    ``links`` has ``a`` and ``b``. First all of a node's links are hung on the smallest of its neighbours, which
    leaves about one link for each node however many lead to the same few others. Then every round takes the smallest label among a node's neighbours and
    then that label's own label, so long chains shrink by more than a step; each round is a written table.
    """
    lowest = links.groupBy("a").agg(F.min("b").alias("_b")).select("a", F.least("a", "_b").alias("low"))
    hung = links.join(lowest, "a").select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low"))).alias("l"))
    links = staged(hung.select(F.col("l.a").alias("a"), F.col("l.low").alias("b")).where("a <> b").distinct(), "hung-links")
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        offered = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        near = labels.join(offered, "node").select(
            "node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        target = labels.select(F.col("node").alias("_new"), F.col("component").alias("_jump"))
        moved = staged(near.join(target, "_new").select("node", "_old", F.least("_new", "_jump").alias("component")), "labels")
        if moved.where("component <> _old").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")

"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextmill.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its smallest node.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so a path of
    length n needs about log n rounds. Labels are written tables, only a count of changed rows reaches the driver, and
    minima are pre-aggregated, so a hub's edges never meet in one task. No edges: an empty table.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), f"{tag}-both")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{tag}-0")
    step = 0
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        best = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        up = labels.select(F.col("node").alias("via"), F.col("component").alias("jump"))
        step += 1
        jumped = best.join(up, best.component == up.via, "left").select("node", "old", F.least("component", F.coalesce("jump", "component")).alias("component"))
        new = scratch.save(jumped, f"{tag}-{step}")
        scratch.drop(f"{tag}-{step - 1}")
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            scratch.drop(f"{tag}-both")
            return labels

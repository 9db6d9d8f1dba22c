"""Connected components of an edge table, by propagating the smallest label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.scratch import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b): (node, component) for the nodes that have an edge; a component is named by its smallest node.

    Every step a node takes the smallest label around it, then the label of its label, so
    that paths halve. Labels are kept in written tables; sums of changes alone reach the driver.
    """
    both = materialize(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), F.col("label")), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "low").alias("new"), "label")
        jump = step.select(F.col("node").alias("to"), F.col("new").alias("far"))
        after = step.join(jump, step["new"] == jump["to"], "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), F.col("label").alias("old"))
        after = materialize(after, "labels")
        changed = after.where("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")

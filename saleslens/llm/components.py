"""Connected components of a graph given by its edges, as Spark joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import stage


def connected_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """`node` and `component`, the smallest node that its edges lead to.

    Nodes without an edge don't appear. Edges with a null end and loops are
    left out; repeated edges and both directions are welcome. Each round every
    node takes the smallest label around it, then the label of its label, so
    the number of rounds grows with the logarithm of the longest path. Labels
    are staged each round; nothing but one count comes to the driver.
    """
    ends = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("a <> b")
    both = stage(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    nodes = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = stage(nodes.select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("before")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        after = stage(
            lower.join(jump, "component").select("node", F.least("component", "beyond").alias("component"), "before"),
            "labels",
        )
        labels = after.select("node", "component")
        if after.filter("component <> before").isEmpty():
            return labels


def with_component(df: DataFrame, key: Column, labels: DataFrame, name: str = "component") -> DataFrame:
    """`df` with the component of `key` in `name`; the key itself where no edge touches it."""
    found = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    joined = df.join(found, key == F.col("_node"), "left")
    return joined.withColumn(name, F.coalesce("_component", key)).drop("_node", "_component")

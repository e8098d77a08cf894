"""Connected components of a graph given by its edges, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a long, b long); a component is named by its
    smallest node.  Each round points every node at its smallest neighbour, follows the pointer
    once more and contracts the edges; rounds grow with the logarithm of the longest path.  Every
    round is a written table, so lineage stays short and lost executors cost one round."""
    edges = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        parent = materialize(parent.select(F.col("a").alias("node"), "p"), "parents")
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = materialize(parent.join(up, "p").select("node", F.col("pp").alias("p")), "parents")
        if labels is None:
            labels = parent.withColumnRenamed("p", "component")
        else:
            step = parent.select(F.col("node").alias("component"), "p")
            labels = materialize(labels.join(step, "component", "left").select(
                "node", F.coalesce("p", "component").alias("component")), "labels")
        a = parent.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        b = parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        edges = materialize(edges.join(a, "a").join(b, "b").filter("pa <> pb").select(
            F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels

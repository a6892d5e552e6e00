"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b): the smallest node that it reaches.

    Each round gives every node the least label among its neighbours and then follows the label's own label, so long
    chains shrink by doubling. Minima combine map-side; a node with very many edges is one joined row per edge, and the
    join's skewed partitions are split. A round starts from checkpointed tables."""
    ends = edges.select("a", "b").filter("a <> b").distinct()
    both = cut(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = cut(labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was")))
        up = lower.select(F.col("node").alias("to"), F.col("to").alias("further"))
        moved = cut(lower.join(up, "to").select("node", F.least("to", "further").alias("component"), "was"))
        labels = moved.select("node", "component")
        if moved.filter("component <> was").isEmpty():
            return labels

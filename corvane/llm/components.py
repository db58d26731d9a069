"""Connected components of an edge table by hooking to the least neighbour and pointer jumping.

Every round at least halves the nodes that still have edges, and every step is an aggregate or an equi-join with one
row a key on one side, so a hot label is split by adaptive execution and nothing gathers a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a long, b long) to (node, root): the least node reachable from each node that has an edge."""
    edges = scratch.table(edges.select("a", "b").where("a <> b").distinct())
    both = lambda e: e.union(e.select("b", "a"))
    labels = scratch.table(both(edges).select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while not edges.isEmpty():
        parents = both(edges).groupBy(F.col("a").alias("root")).agg(F.min("b").alias("least"))
        parents = scratch.table(parents.select("root", F.least("root", "least").alias("parent")))
        while True:
            up = parents.select(F.col("root").alias("parent"), F.col("parent").alias("next"))
            jumped = scratch.table(parents.join(up, "parent").select("root", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")))
            parents = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        labels = scratch.table(labels.join(parents, "root", "left").select("node", F.coalesce("parent", "root").alias("root")))
        to = lambda c: parents.select(F.col("root").alias(c), F.col("parent").alias(f"{c}_root"))
        edges = edges.join(to("a"), "a").join(to("b"), "b").where("a_root <> b_root")
        edges = scratch.table(edges.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
    return labels

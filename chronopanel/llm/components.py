"""Connected components of an edge table by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _compressed(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent a root. Parents are smaller than their nodes, so the depth halves each round."""
    while True:
        up = parents.select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
        step = parents.join(up, F.col("parent") == F.col("__n"), "left").select("node", F.coalesce("__p", "parent").alias("next"), (F.coalesce("__p", "parent") != F.col("parent")).alias("moved"))
        step = stored(step, "jump")
        moved = not step.where("moved").isEmpty()
        parents = step.select("node", F.col("next").alias("parent"))
        if not moved:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the smallest node of its component.

    Each round joins every node to its smallest neighbour (a combined minimum, so a hub costs one row a task), contracts,
    and keeps the distinct edges left between roots; the number of roots with edges at least halves. All state is in
    tables of the shared folder. Null ends and loops are dropped; no edges give no rows.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = _compressed(stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")), "hook"))
        if total is None:
            total = hooked
        else:
            up = hooked.select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
            total = stored(total.join(up, F.col("parent") == F.col("__n"), "left").select("node", F.coalesce("__p", "parent").alias("parent")), "total")
        ra, rb = (hooked.select(F.col("node").alias(x), F.col("parent").alias(f"r{x}")) for x in "ab")
        edges = stored(edges.join(ra, "a").join(rb, "b").where("ra != rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return total.select("node", F.col("parent").alias("root"))

"""Entity graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored


def node_table(edges: DataFrame) -> DataFrame:
    """(id, degree, lanes) of the ends of edges (a, b, type)."""
    ends = edges.select(F.col("a").alias("id"), "type").unionByName(edges.select(F.col("b").alias("id"), "type"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("lanes"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): every end of edges (a, b) with the smallest node of its component.

    Labels take the least label of their neighbours and then of their label's label, so paths halve each round. Minima
    are combined before the exchange; each round is written out, and stops when no label moves.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "graph")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("r"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "root", F.least("root", F.coalesce("r", "root")).alias("next"))
        up = labels.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        step = stored(step.join(up, F.col("next") == F.col("__n"), "left").select("node", F.least("next", F.coalesce("__r", "next")).alias("next"), "root"), "graph")
        moved = not step.where("next != root").isEmpty()
        labels = step.select("node", F.col("next").alias("root"))
        if not moved:
            return labels

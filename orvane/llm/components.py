"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for the nodes of (a, b) long edges; the label is the component's smallest node.

    Each round takes the least label among a node and its neighbours, and then
    that label's own label; tables are written between rounds.  The edges are
    written before they are turned round: reckoned twice, they may be other
    edges of the same components.
    """
    edges = written(edges.where("a <> b").select("a", "b"), "links")
    both = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = written(least.join(up, least["label"] == up["_n"], "left").select("node", "was", F.least("label", F.coalesce("_l", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")

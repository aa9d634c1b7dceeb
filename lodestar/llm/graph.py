"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: a, b (any comparable type).  Returns node, label: the smallest node that links reach.

    Each round gives every node the smallest label among itself and its neighbours, then that label's own label.
    Minima are partially aggregated, so a hub's links are reduced before they are shuffled; each round is written.
    """
    both = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.u == labels.node).groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = materialise(step.join(jump, "label", "left").select("node", "was", F.least("label", "up").alias("label")), "labels")
        discard(labels)
        labels = after.select("node", "label")
        if after.where("was <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    discard(both)
    return labels


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of an earlier result once `edges` (a, b) are added: only the graph of its labels is searched."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = materialise(between.select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")), "between")
    moved = components(between.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("moved"))
    new = between.select(F.col("a").alias("node")).unionByName(between.select(F.col("b").alias("node"))).distinct().join(labels, "node", "left_anti")
    whole = labels.unionByName(new.withColumn("label", F.col("node")))
    return materialise(whole.join(moved, "label", "left").select("node", F.coalesce("moved", "label").alias("label")), "labels")

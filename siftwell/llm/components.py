"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared


def components(edges: DataFrame, shared: Shared, name: str) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): the smallest node that each reaches.

    A round takes the least label among neighbours, then the label of one's label, so long
    chains shrink by halves.  Each round is a table in the shared folder; rounds end when
    no label changes.
    """
    both = shared.save(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = shared.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        lower = shared.save(lower, f"{name}-{turn}-low")
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("over"))
        after = lower.join(jump, lower.label == jump["at"]).select("node", F.col("over").alias("label"), (F.col("over") != F.col("before")).alias("moved"))
        after = shared.save(after, f"{name}-{turn}")
        moved = after.where("moved").limit(1).count()
        shared.drop(f"{name}-{turn - 1}")
        shared.drop(f"{name}-{turn}-low")
        labels = after.select("node", "label")
        if not moved:
            shared.drop(f"{name}-edges")
            return labels


def relabelled(labels: DataFrame, links: DataFrame, shared: Shared, name: str) -> DataFrame:
    """labels (node, label) after the links (a, b) between their nodes: components of the components that links join."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    joined = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a != b").distinct(), shared, f"{name}-of")
    return shared.save(labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), name)

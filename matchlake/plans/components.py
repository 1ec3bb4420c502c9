"""Connected components of bounded edge tables, by smallest labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .materialize import materialised


def component_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``label`` for every node of ``edges``: the smallest node of its component (long ids; loops are allowed).

    A round gives every node the smallest label among its own and its neighbours', then the label of that label, so the
    distance to the smallest node halves at least once labels point along a path. Rounds are written to the shared checkpoint
    folder, and a round that changes nothing ends the loop. Neighbours' labels are joined by node and combined by partial
    aggregates, so a node with very many edges is no single group.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = materialised(both.union(both.select("other", "node")).distinct())
    labels = materialised(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "theirs").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("further"))
        moved = materialised(least.join(jump, "least").select("node", "label", F.least("least", "further").alias("new")))
        settled = moved.where("new < label").isEmpty()
        labels = moved.select("node", F.col("new").alias("label"))
        if settled:
            return labels

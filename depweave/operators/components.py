"""Weakly connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.plans.staging import stage, unstage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every endpoint of an edge; a component is named by its least node.

    Each round takes the least label among a node's neighbours, then jumps to the label of that
    label, so a chain of n nodes needs about log n rounds. Labels are folded with partial minima
    before they are shuffled, so a node with very many neighbours costs one row per task. Rows with
    a null endpoint are ignored; loops give a component of one node; an empty input gives no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")),
        "labels",
    )
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("m"))
        )
        least = labels.join(around, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "m").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("component").alias("top"))
        new = stage(
            least.join(up, "mid", "left").select("node", F.least("mid", "top").alias("component"), (F.least("mid", "top") != F.col("was")).alias("moved")),
            "labels",
        )
        moved = new.where("moved").limit(1).count()
        unstage(labels)
        labels = new.select("node", "component")
        if not moved:
            unstage(both)
            return labels

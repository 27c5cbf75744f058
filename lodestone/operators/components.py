"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.lineage import release, settle


def connected_components(edges: DataFrame, *inputs: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b): the smallest node that it reaches.

    Each round gives a node the smallest label among itself and its neighbours and then the label of
    that label, so that paths halve; every round is written to the shared folder, which bounds lineage.
    inputs: the settled tables that the edges are read from, if they are (see ``settle``)."""
    edges = edges.select("a", "b").where("a <> b").distinct()
    both = settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), *inputs)
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), both)
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = met.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = settle(met.join(root, "label").select("node", "old", F.least("label", "root").alias("label")), both)
        changed = new.where("old <> label").limit(1).count()
        release(labels)
        labels = new.select("node", "label")
        labels.settled_at = new.settled_at
        if not changed:
            release(both)
            return labels

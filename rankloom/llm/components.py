"""Connected components by repeated hooking to the smallest neighbour and pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_saved, saved


def _flattened(parent: DataFrame) -> DataFrame:
    """Follows each parent to its root, halving the way in each round. Parents are smaller than their children, so there is no cycle."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        nearer = saved(parent.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
        if not nearer.filter("moved").limit(1).count():
            return nearer.drop("moved")
        parent = nearer.drop("moved")


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, component) of all nodes that have an edge (a, b) or a label so far; component: the smallest node or label reachable."""
    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if labels is None:
        labels = nodes.select("node", F.col("node").alias("component"))
    else:
        labels = nodes.join(labels, "node", "full_outer").select("node", F.coalesce("component", "node").alias("component"))
    labels = saved(labels, "labels")
    while True:
        a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        across = edges.join(a, "a").join(b, "b").filter("ca <> cb").select(F.greatest("ca", "cb").alias("node"), F.least("ca", "cb").alias("parent"))
        parent = saved(across.groupBy("node").agg(F.min("parent").alias("parent")), "hooks")
        if not parent.limit(1).count():
            return labels
        root = _flattened(parent).select(F.col("node").alias("component"), F.col("parent").alias("root"))
        older = labels
        labels = saved(labels.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        drop_saved(older)

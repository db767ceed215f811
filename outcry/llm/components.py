"""Connected components of a graph that fits no single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcry.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is one node of its component.

    Each round every node points to its smallest neighbour or itself, two steps of pointers are taken at once, and the
    graph is contracted to what the nodes point to. At least half of the nodes go in a round. Only a sum for each node is
    formed, so a node with very many neighbours is no large group; joins on it are salted.
    """
    both = edges.select("a", "b").filter("a <> b")
    live = common.written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while not live.isEmpty():
        pairs = live.select(F.col("b").alias("node"), F.col("a").alias("near")).unionByName(live.select(F.col("a").alias("node"), F.col("a").alias("near")))
        parents = common.written(pairs.groupBy("node").agg(F.min("near").alias("parent")), "cc-parents")
        again = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        roots = common.written(common.salted_join(parents, again, ["parent"], F.col("node")).select("node", "root"), "cc-roots")
        left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = common.salted_join(common.salted_join(live, left, ["a"], F.col("b")), right, ["b"], F.col("a")).filter("ra <> rb")
        live = common.written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        if labels is None:
            labels = roots
        else:
            step = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = common.salted_join(labels, step, ["root"], F.col("node"), how="left")
            labels = common.written(labels.select("node", F.coalesce("next", "root").alias("root")), "cc-labels")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels

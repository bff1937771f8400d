"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is one of the component's nodes.

    Contraction: each node is replaced by the smallest of itself and its
    neighbours, links between nodes that have become one vanish, and what is
    left is contracted again.  The largest nodes of every neighbourhood go, so
    the table shrinks quickly.  Grouping is by partial minimum, hence a node
    with very many links is no burden for one task.
    """
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        step = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "step")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        moved = links.join(left, "a").join(right, "b").where("la <> lb")
        links = materialize(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = steps[0]
    for step in steps[1:]:
        labels = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return materialize(labels, "labels")

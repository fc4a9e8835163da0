"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookloom.session import stage_table


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of ``a``–``b``.

    Each round points every node at its smallest neighbour, follows the pointers until all
    lead to roots, and contracts the graph to the roots. Every node with a link is merged,
    so rounds number at most the logarithm of the nodes. All steps are joins and minima of
    two-column tables, written to the shared folder; links to oneself and repeats are fine.
    """
    edges = stage_table(_canonical(links), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        parent = _to_roots(stage_table(parent, "parents"))
        rounds.append(parent)
        left = parent.select("a", F.col("p").alias("pa"))
        right = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        edges = stage_table(_canonical(moved), "links")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for later in rounds[1:]:
        step = later.select(F.col("a").alias("root"), "p")
        found = found.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return stage_table(found, "components")


def _canonical(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def _to_roots(parent: DataFrame) -> DataFrame:
    """Pointers doubled until none changes; they fall, so they form trees."""
    while True:
        upper = parent.select(F.col("a").alias("old"), "p")
        jumped = stage_table(parent.withColumnRenamed("p", "old").join(upper, "old").select(
            "a", "p", (F.col("p") != F.col("old")).alias("moved")
        ), "parents")
        parent = jumped.select("a", "p")
        if jumped.filter("moved").isEmpty():
            return parent

"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(id, component)`` for every id in ``links``: the smallest id that links lead to.

    Contraction: each id moves to its smallest neighbour, twice per round, and links inside a merged id vanish, so
    that at least half of the ids go in every round. Only the question whether links remain comes to the driver.
    Groups with a hot id are counted map-side; each round is written to the shared folder and read back, so that
    joins meet plain scans (which Spark may split) and lost executors cost one round at most. Null ids and links of
    an id to itself are left out.
    """
    edges = (
        links.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
        .where("a < b")
        .distinct()
    )
    edges = settle(edges, "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = settle(
            both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("up")),
            "parents",
        )
        above = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
        parent = settle(parent.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up")), "parents")
        if labels is None:
            labels = parent.select("id", F.col("up").alias("component"))
        else:
            moved = labels.join(parent.withColumnRenamed("id", "component"), "component", "left")
            labels = settle(moved.select("id", F.coalesce("up", "component").alias("component")), "labels")
        first = parent.select(F.col("id").alias("a"), F.col("up").alias("top_a"))
        second = parent.select(F.col("id").alias("b"), F.col("up").alias("top_b"))
        edges = settle(
            edges.join(first, "a")
            .join(second, "b")
            .select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b"))
            .where("a < b")
            .distinct(),
            "links",
        )
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels

"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.plans.storage import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: larger neighbours of each node go to its smallest one. Small: smaller ones do,
    and the node itself."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    least = stage(least, "component-least")
    met = both.join(least, "a")
    if large:
        found = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        found = met.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b"))
        )
    return found.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """`(node, root)` of every node in `links` `(a, b)`; root is the smallest node reachable.

    A hub with most of the links is one partial minimum per task and a join that the
    optimizer may split; links to the driver are never needed.
    """
    edges = stage(links.where("a <> b").select("a", "b").distinct(), "component-links")
    while True:
        large = stage(_star(edges, True), "component-large")
        small = stage(_star(large, False), "component-small")
        # done when every node points at a root that points nowhere
        pending = small.join(small.select(F.col("a").alias("b")), "b", "left_semi")
        several = small.groupBy("a").count().where("count > 1")
        if pending.isEmpty() and several.isEmpty():
            roots = small.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = small

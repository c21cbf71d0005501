"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A node with more than this share of all links is a hub; there are under 2 / HUB of them.
HUB = 1 / 1000
#: Fewer links than this are no matter for one task.
LEAST = 20


def components(edges: DataFrame, hub: float = HUB) -> DataFrame:
    """node, label for every node of edges (a, b); label is the smallest node of its component.

    No neighbour list is ever collected: each step takes minima by pre-aggregated group-bys
    and joins them back. The minima of hubs, a bounded number, are broadcast, so that their
    links stay where they are; no other node has more than a share of ``hub`` of the links. The table is written
    after each round; rounds grow with the logarithm of the longest path. Loops, repeated
    and null edges are allowed; an empty table gives an empty one.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL")
    nodes = now.select(F.col("a").alias("node")).unionByName(now.select(F.col("b").alias("node"))).distinct()
    now = cut(oriented(now.where("a != b")).distinct(), "components", slim=True)
    while not stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, now.count(), hub).select("a", "b", F.least("a", "m").alias("m"))
        large = oriented(large.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = cut(large.distinct(), "components-large", slim=True)
        small = with_least(large, large.count(), hub).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(oriented(small.unionByName(large.groupBy("a").agg(F.min("b").alias("b")))).distinct(), "components", slim=True)
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def with_least(edges: DataFrame, total: int, hub: float) -> DataFrame:
    """edges (a, b) with m, the least b of their a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = least.where(F.col("n") > total * hub).where(F.col("n") > LEAST).select("a", "m").collect()  # under 2 / hub rows
    least = least.select("a", "m")
    if not hubs:
        return edges.join(least, "a")
    known = F.broadcast(edges.sparkSession.createDataFrame(hubs, least.schema))
    return edges.join(known, "a").unionByName(edges.join(known, "a", "left_anti").join(least, "a"))


def oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")


def stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none."""
    inner = edges.select(F.col("b").alias("a")).distinct()
    several = edges.groupBy("a").count().where("count > 1").select("a")
    return edges.select("a").join(inner, "a", "left_semi").unionByName(several).isEmpty()

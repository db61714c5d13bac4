"""Connected components of an undirected graph given as links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: the larger neighbours of each node, or the smaller ones and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = side.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = side.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node that has a link.

    Links to itself and null ends count for nothing. Each round writes the remaining edges, at most
    as many as before, to the shared folder; rounds grow with the logarithm of the longest path.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    before = None
    while True:
        edges = written(_star(written(_star(edges, large=True), "star-large"), large=False), "star-small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # now every edge leads from a node to the root of its star
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of a table of links between nodes of any type with an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for every node of a link the smallest node that it is connected with.

    Large-star and small-star steps in turn: each node hangs its larger, then its
    smaller, neighbours under the smallest neighbour, until nothing changes. A
    step writes at most two rows for each link, and combines before the shuffle.
    """
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    edges = materialize(links.where(F.col(a) != F.col(b)).select(low, high).distinct())
    mark = None
    while True:
        # every node hangs its larger neighbours under the smallest node it knows
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
            edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
        )
        # stored, so that a join partition of a node with very many links can be split
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()
        # and then itself and its smaller neighbours
        up = large.groupBy("high").agg(F.min("low").alias("m"))
        hung = large.join(up, "high").select(F.col("m").alias("p"), F.col("low").alias("q")).where("p != q")
        small = up.select(F.col("m").alias("p"), F.col("high").alias("q")).unionByName(hung)
        edges = materialize(small.select(F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())

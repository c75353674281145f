"""Connected components by alternating large-star and small-star rounds over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, root): each node but the roots, with the smallest node it can reach.

    Every round is a few joins and grouped minima over edges, kept in the shared folder; a hub only
    ever meets its own minimum, so AQE can split its side of the join. The number of rounds grows with
    the logarithm of the longest path. Edges with a null end or equal ends are ignored.
    """
    pairs = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(pairs, "edges")
    while not is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return now.select("u", F.col("v").alias("root"))


def is_star_forest(edges: DataFrame) -> bool:
    forked = edges.groupBy("u").count().where("count > 1")
    chained = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
    return forked.isEmpty() and chained.isEmpty()

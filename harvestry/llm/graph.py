"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """Rows (node, component): the smallest node reachable, for every node of a link (a, b).

    Each round links every node and its neighbours to the smallest of them (large star, then small star); sums, minima
    and joins only, so a hub of any degree costs one row a link. The rounds needed grow with the logarithm of the
    longest path. An empty table of links gives an empty result.
    """
    edges = work.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    while True:
        before = edges
        # large star: larger neighbours of a node move to its smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b")
        # small star: a node's smaller neighbours, and itself, move to the smallest of them
        least2 = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least2, "b")
        small = joined.select(F.col("m").alias("a"), "b").union(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        edges = work.write(small, "edges")
        done = edges.count() == before.count() and edges.exceptAll(before).isEmpty()
        work.drop(before)
        if done:
            break
    stars = edges.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
    return stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

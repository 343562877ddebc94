"""Connected components of a table of links, by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of `links` (a, b).

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour; links turn into
    stars in a number of rounds that grows with the logarithm of the longest chain. A hub is pre-aggregated before each
    shuffle by min, and the join back to its links is one that skew handling can split. Null nodes are not allowed.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # large star: u's larger neighbours hang on the smallest of u and its neighbours
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = edges.join(low, F.col("v") == F.col("c")).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        joined = large.join(least, F.col("u") == F.col("c"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        after = checkpointed(small.where("u <> v").distinct())
        same = edges.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if same == after.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first():
            break
        edges = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)

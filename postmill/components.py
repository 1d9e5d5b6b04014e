"""Connected components of a large edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of an edge; root is the smallest node that can be reached.

    Each round hangs every neighbour on the smallest one it can see; the rounds grow with the
    logarithm of the longest path. Minima are combined before they are shuffled and written before they are joined
    with the edges, so that adaptive execution can split a node with many edges; every step is a table in the
    shared folder, deleted when the round is over."""
    now = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = now.union(now.select("b", "a"))
        least = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b")))
        large = materialize(large.distinct(), "large-stars")
        down = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "down")
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        last, now = now, materialize(small.distinct(), "edges")
        discard(last, least, large, down)
        if now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())

"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, written


def _large(edges: DataFrame) -> DataFrame:
    """Neighbours above a node are tied to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node that has an edge (a, b) to another; comp is the smallest node reachable.

    Each round is a table in the shared folder; rounds grow with the logarithm of the nodes.
    """
    now = written(edges.select("a", "b").filter("a != b").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
            )
        seen = state
        # in a star every edge ends in the smallest node of its component
        before, now = now, written(_small(_large(now).filter("a != b").distinct()).filter("a != b").distinct(), "edges")
        forget(before)

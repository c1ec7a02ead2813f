"""Connected components of links by alternating large-star and small-star rounds.

Each round is a minimum per node and a join back, both of which combine or split
hot nodes; the number of rounds grows with the logarithm of the longest chain.
Links never reach the driver: only a count and a checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _small(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))  # e has a > b
    return e.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a > b").distinct()


def _large(e: DataFrame) -> DataFrame:
    """Each larger neighbour of a node points to the node's smallest neighbour or itself."""
    both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b) between integers; component is its smallest node."""
    e = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    seen = None
    while True:
        state = e.agg(F.count("a").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        before, e = e, materialize(_small(_large(e)), "links")
        discard(before)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

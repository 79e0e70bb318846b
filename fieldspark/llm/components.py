"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored


def _neighbours_to_smallest(links: DataFrame, larger_only: bool) -> DataFrame:
    """Links each node's neighbours (all, or the node with its smaller ones) to the smallest of
    them. A hot node is one row of the aggregate and a skewed join side that Spark can split."""
    if larger_only:  # large star: neighbours in both directions, keep those beyond the node
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        pairs = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), "least")
    else:  # small star: neighbours below the node
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        pairs = (
            down.join(least, "a")
            .select(F.col("b").alias("x"), "least")
            .unionByName(least.select(F.col("a").alias("x"), "least"))
        )
    return pairs.where("x != least").select(F.col("least").alias("a"), F.col("x").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b); nodes without a link
    are left out. Alternates large-star and small-star rounds, which end after a logarithmic number
    of rounds in practice; each round is stored, so its lineage is cut."""
    links = stored(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        links = stored(_neighbours_to_smallest(_neighbours_to_smallest(links, True), False))
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )

"""Connected components of an edge table, by alternating stars.

Every round replaces edges by edges to the smallest neighbour (first among larger nodes, then among smaller ones), so each
component shrinks to a star around its smallest node in a number of rounds that grows with the logarithm of its size. Minima are summed up
before the shuffle, and the join back to a hub's edges has one row for each hub on its other side, so Spark can split a hub over tasks. Nothing of the graph
comes to the driver but one checksum for each round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.batches import checkpointed

MOST_ROUNDS = 50


def star(edges: DataFrame, larger: bool) -> DataFrame:
    """One half round over edges (u, v). ``larger``: link each node's larger neighbours to its least neighbour, else the smaller ones."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
    joined = both.join(least, F.col("u") == F.col("n"))
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, kept: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(node, component) for each node of the edges (u, v); the component is its smallest node. Self-loops are ignored. ``kept`` stores the edges of a round and reads them again."""
    now = kept(edges.select("u", "v").where("u <> v").distinct())
    last = None
    for _ in range(MOST_ROUNDS):
        total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(total) == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = tuple(total)
        now = kept(star(star(now, True), False))
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")

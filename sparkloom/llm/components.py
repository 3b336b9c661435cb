"""Connected components of an edge table by large-star / small-star rounds.

Each round is two group-bys over the edges; no list of a node's neighbours is ever gathered, only its
smallest one, which each map task combines first. The joins back to the edges are inner joins on the node, which
adaptive execution splits where a hub's edges make a partition skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_smallest(neighbours: DataFrame, keep: str) -> DataFrame:
    """Link each of a node's neighbours (``keep``: those above it, or all) to the smallest in its neighbourhood."""
    least = neighbours.groupBy("a").agg(F.min("b").alias("_low")).withColumn("_low", F.least("a", "_low"))
    pairs = neighbours.filter(keep).join(least, "a")
    return pairs.select(F.col("b").alias("a"), F.col("_low").alias("b"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: any one orderable type, no nulls); root is the smallest node reachable.

    Self loops are ignored; no edges give no rows.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        large = _to_smallest(_both(edges), "b > a").filter("a <> b").distinct()
        # small star: neighbours below a node, and the node itself, go to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("_low"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("_low").alias("b")).unionByName(low.select("a", F.col("_low").alias("b")))
        edges = materialize(small.filter("a <> b").distinct(), "cc")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

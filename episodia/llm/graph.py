"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node, itself included, to the smallest of them.

    ``large``: neighbours greater than the node are linked; else those smaller and the node itself.
    """
    both = edges.union(edges.select("b", "a")).toDF("u", "v") if large else edges.select(
        F.greatest("a", "b"), F.least("a", "b")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("hub"), F.least("u", "m").alias("m"))
    # a hub with very many neighbours is a skewed join key, which Spark splits
    joined = both.join(least, F.col("u") == F.col("hub"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("hub").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b) but the smallest ones.

    Each round writes its edges, so that a lost executor costs a re-read; only counts and sums of hashes come to
    the driver. Ends when a round changes nothing, in about the logarithm of the longest path.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct())
    state = None
    for _ in range(rounds):
        found = edges.agg(F.count(F.lit(1)).alias("n"),
                          F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == tuple(found) or not found["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(found)
        edges = materialize(_stars(_stars(edges, large=True), large=False))
    raise RuntimeError(f"no stable components after {rounds} rounds")

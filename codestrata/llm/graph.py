"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star then one small-star step; edges are (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
    return small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    ``edges`` has two long columns; self-loops and repeats are harmless, an empty table gives an empty one.
    Each round is written to the shared folder, so the plan stays short and survives lost executors.
    Rounds go on until the edges no longer change, about the square of the logarithm of the nodes at
    most; more than ``rounds`` is an error, never an incomplete result.
    """
    a, b = edges.columns
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        e = cut(_stars(e))
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    leaf = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaf.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

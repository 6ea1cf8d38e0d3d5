"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch


def _star(scratch: Scratch, edges: DataFrame, large: bool) -> DataFrame:
    """One star step; edges (a, b) hold b < a. The minimum per node is written before the join,
    so both join sides are plain shuffles and a hub's rows can be split."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = scratch.table(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    result = scratch.table(out.filter("a <> b").distinct())
    scratch.drop(least)
    return result


def _settled(edges: DataFrame) -> bool:
    """Whether every node that points at a smaller one points at one alone, at which none points further."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).filter("up > 1 OR (up = 1 AND least = 0)").isEmpty()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    ``edges`` has long columns a and b; nulls and loops are ignored. The loop ends when each node points
    straight at its root, which stars of edges do from the start.
    """
    current = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(current):
        wide = _star(scratch, current, large=True)
        scratch.drop(current)
        current = _star(scratch, wide, large=False)
        scratch.drop(wide)
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _hung(both: DataFrame, pairs: DataFrame, include_self: bool) -> DataFrame:
    """Each (u, v) of pairs with v hung under the least of u and both's neighbours of u."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if include_self:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component): nodes of the edges (u, v), and the smallest node that each reaches.

    Only minima of a node's edges are shuffled; no component is ever gathered in one place. The end is a forest of stars:
    each node but the least of its component has one edge, to that least one. The number of rounds grows with the
    logarithm of the graph; edges that are stars already take none.
    """
    now, k = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0"), 0
    while True:
        # A node is at fault if it has two edges down, or both one down and one up.
        down, up = now.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n")), now.select(F.col("v").alias("node")).distinct()
        if down.where("n > 1").select("node").unionByName(down.select("node").join(up, "node", "left_semi")).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        k += 1
        turned = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hung(turned, turned.where("v > u"), False).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _hung(large, large, True)
        now = scratch.write(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")

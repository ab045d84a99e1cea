"""Connected components of an edge table by alternating large and small stars.

Every round is a map-side combined minimum per node and a join that can split a hot node; components are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def _mins(e: DataFrame, at: str, other: str) -> DataFrame:
    return e.groupBy(F.col(at).alias("u")).agg(F.least(F.min(other), F.first(at)).alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (least node of its component) of every node of ``edges``; loops and repeated edges do no harm."""
    e = materialise(edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x > y").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = both.join(_mins(both, "x", "y"), F.col("x") == F.col("u")).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        down = large.join(_mins(large, "x", "y"), F.col("x") == F.col("u"))
        small = down.select(F.col("x"), F.col("m").alias("y")).unionByName(down.select(F.col("y").alias("x"), F.col("m").alias("y")))
        e = materialise(small.where("x > y").distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.hash("x", "y").cast("long"))).first())
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("x").alias("node"), F.col("y").alias("label"))
    return nodes.unionByName(nodes.select(F.col("label").alias("node"), "label").distinct())

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpointed


def _hooked(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours (only the larger, or only the smaller ones and itself) are tied to the least of its neighbourhood."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    if not larger:
        sides = sides.filter("v < u")
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if larger:  # edges (v, m) for v > u
        out = sides.filter("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:  # edges (v, m) for v < u, and (u, m)
        out = sides.join(least, "u").select(F.explode(F.array("v", "u")).alias("b"), F.col("m").alias("a"))
    return out.filter("a < b").select("a", "b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, component: the smallest node reachable. Only nodes with an edge to another node appear.

    Each round's edges are checkpointed, so lost executors cost one round at most; a logarithmic number of rounds is needed.
    """
    edges = checkpointed(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state = mark
        edges = checkpointed(_hooked(_hooked(edges, larger=True), larger=False))
    # every edge now leads from a node to its component's least node
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

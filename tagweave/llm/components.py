"""Connected components by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import discard, materialise


def _mins(pairs: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours. Written, so that a node with very many links is
    dealt over several tasks in the join that follows."""
    return materialise(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "mins")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v): component is the smallest node reachable.

    Each step is two joins on a node and a distinct; nothing but a count and checksums reaches the
    driver. Self links and repeated links change nothing; no links give no rows.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _mins(both)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        mins = _mins(large)
        small = large.join(mins, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, materialise(small.union(mins.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(old, least, large, mins)
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))

"""Connected components by alternating large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.scratch import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (u, v) but the roots: comp is the smallest node
    reachable.

    Every step takes a minimum by node, combined before its shuffle, and sends it to the node's
    edges, so no neighbourhood is gathered. Steps end when the edges no longer change; the number
    of steps grows with the logarithm of the longest path. Self-loops and repeated edges are fine.
    """
    edge = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edge, before = keep(edge, "edges"), None
    while True:
        mark = edge.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if mark == before or mark[0] == 0:
            return edge.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = mark
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = keep(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")

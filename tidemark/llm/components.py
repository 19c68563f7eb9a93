"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternates the two star steps of Kiveris et al. (2014) until nothing changes: each links the
    neighbours of a node to the smallest of them, so a hub costs one row per neighbour and never a pair
    of neighbours. Each round is written to the shared folder. Self-links and repeated edges are fine.
    """
    found = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while (now := _fingerprint(found)) != before:
        before = now
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        found = written(small.filter("a <> b").distinct(), "edges")
    nodes = found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

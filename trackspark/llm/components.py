"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.session import cut_lineage


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b`` but the smallest of its component.

    The component is its smallest node. Each round halves at least the distance to it; every step is
    a join and an aggregation on the node, and rounds stop when the edges no longer change.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = cut_lineage(edges, "edges")
    before = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        edges = cut_lineage(small, "edges")
        after = _fingerprint(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after

"""Connected components of an edge table inside groups (the identities of one video, ...).

Every step is a join and an aggregation by node, so neither a group nor a component has to fit a task.
Each round hangs the neighbours of a node on its least neighbour, first those above it, then those
below; edges end as stars around the least node of their component.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.session import cut_lineage


def _hang(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every ``low`` neighbour of a ``high`` node, and the node, on the least of them."""
    least = edges.groupBy(*keys, "high").agg(F.min("low").alias("_m"))
    moved = edges.join(least, [*keys, "high"]).select(*keys, F.col("low").alias("high"), F.col("_m").alias("low"))
    return moved.unionByName(least.withColumnRenamed("_m", "low")).filter("high > low").distinct()


def _lift(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every neighbour above a node on the least node around it (itself counts)."""
    turned = edges.select(*keys, F.col("low").alias("high"), F.col("high").alias("low"))
    around = edges.unionByName(turned)
    least = around.groupBy(*keys, "high").agg(F.least(F.col("high"), F.min("low")).alias("_m"))
    moved = around.join(least, [*keys, "high"]).filter("low > high")
    return moved.select(*keys, F.col("low").alias("high"), F.col("_m").alias("low")).filter("high > low").distinct()


def components(edges: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """``keys, node, component`` for every node that is not the least of its component.

    ``a`` and ``b`` have one orderable type; loops and repeated edges change nothing; edges with a
    null key or end are left out; the component is its least node.
    """
    x, y = F.col(a), F.col(b)
    edges = edges.dropna(subset=list(keys)).filter(x.isNotNull() & y.isNotNull() & (x != y))
    edges = edges.select(*keys, F.greatest(x, y).alias("high"), F.least(x, y).alias("low")).distinct()
    edges, before = cut_lineage(edges, "edges"), None
    while True:
        r = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(" + ", ".join([*keys, "high", "low"]) + "))")).first()
        if tuple(r) == before:
            return edges.select(*keys, F.col("high").alias("node"), F.col("low").alias("component"))
        before = tuple(r)
        edges = cut_lineage(_hang(_lift(edges, keys), keys), "edges")

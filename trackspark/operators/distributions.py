"""Exact global order statistics without a task that sees the whole table.

Equal values are counted first (a map-side combined aggregation). The distinct values are then cut into
ranges by sampled splitters, one range a partition, and stored with the partition's number: a prefix sum
over the partitions' totals tells how many rows stand before each range. What remains is a window inside
one partition, whatever the values' distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.session import cut_lineage


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str) -> DataFrame:
    """The rows, range-partitioned and stored, with ``_part`` and ``_before``.

    ``_before``: the weight of the group's rows in earlier partitions. Partition numbers ascend with
    (by, order).
    """
    cut = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    cut = cut_lineage(cut, "ranges")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each group and partition.
    sums = cut.groupBy(*by, "_part").agg(F.sum(weight).alias("_s"))
    before = sums.select(*by, "_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    return cut.join(before, [*by, "_part"])


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """``column, p, value``: exact quantiles of each column, interpolated between neighbours.

    Nulls do not count; a column without values gives null.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = in_ranges(counts, ["column"], ["value"], "n")
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    at = (F.col("rows") - 1) * F.col("p")
    targets = ranged.groupBy("column").agg(F.sum("n").alias("rows")).select("column", "rows", asked)
    targets = targets.select("column", "p", at.alias("at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"))
    # Only the few ranges that hold an asked rank are ordered.
    ends = ranged.groupBy("column", "_part", "_before").agg(F.sum("n").alias("_s"))
    hits = ends.join(targets, "column").filter("rank >= _before and rank < _before + _s")
    parts = hits.select("column", "_part").distinct()
    running = Window.partitionBy("column", "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.join(parts, ["column", "_part"], "left_semi").withColumn("_upto", F.col("_before") + F.sum("n").over(running))
    found = inside.join(hits.select("column", "_part", "p", "at", "rank"), ["column", "_part"]).filter("rank >= _upto - n and rank < _upto")
    share = F.when(F.floor("at") == F.ceil("at"), F.lit(1.0)).otherwise(1 - F.abs(F.col("at") - F.col("rank")))
    found = found.groupBy("column", "p").agg(F.sum(share * F.col("value")).alias("value"))
    spark = df.sparkSession
    every = spark.createDataFrame([(c, float(p)) for c in columns for p in probabilities], "column string, p double")
    return every.join(found, ["column", "p"], "left")


def quantile_row(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], name: str) -> DataFrame:
    """One row: ``<name><column>``, an array with the column's quantiles in the order asked."""
    q = quantiles(df, columns, probabilities)
    one = lambda c, p: F.max(F.when((F.col("column") == c) & (F.col("p") == float(p)), F.col("value")))
    return q.agg(*[F.array(*[one(c, p) for p in probabilities]).alias(f"{name}{c}") for c in columns])


def average_ranks(df: DataFrame, by: Sequence[str], column: str, weight: str, name: str, *, tie: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``: the rank of each row's value in its group, ties averaged; a row counts ``weight`` times.

    ``tie`` columns let a value that most rows share spread over several partitions. Only the first
    and last value of a partition can go on in another; what they count there is joined in, two rows a
    partition and group.
    """
    ranged = in_ranges(df, by, [column, *tie], weight)
    here = Window.partitionBy(*by, "_part")
    upto = here.orderBy(column).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(weight).over(Window.partitionBy(*by, "_part", column))
    rows = ranged.withColumns({"_own": own, "_less": F.col("_before") + F.sum(weight).over(upto) - own})
    ends = rows.groupBy(*by, "_part").agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    ends = ends.select(*by, "_part", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias(column))
    edge = rows.join(ends, [*by, "_part", column]).groupBy(*by, "_part", column).agg(F.first("_own").alias("_own"), F.min("_less").alias("_less"))
    value = Window.partitionBy(*by, column)
    edge = edge.select(*by, "_part", column, F.sum("_own").over(value).alias("_all"), F.min("_less").over(value).alias("_first"))
    rows = rows.join(edge, [*by, "_part", column], "left")
    rank = F.coalesce("_first", "_less") + (F.coalesce("_all", "_own") + 1) / 2
    return rows.withColumn(name, rank).drop("_part", "_before", "_own", "_less", "_all", "_first")


def rank_correlation(counts: DataFrame, by: Sequence[str], x: str, y: str, weight: str) -> DataFrame:
    """``by, spearman`` from a table of distinct (x, y) with their counts; null for a constant column."""
    ranked = average_ranks(average_ranks(counts, by, x, weight, "_rx", tie=[y]), by, y, weight, "_ry", tie=[x])
    n, rx, ry = F.col(weight), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*by).agg(
        F.sum(n).alias("_n"), F.sum(n * rx * ry).alias("_xy"), F.sum(n * rx * rx).alias("_xx"), F.sum(n * ry * ry).alias("_yy")
    )
    # Average ranks of n rows have the mean (n + 1) / 2.
    square = F.col("_n") * ((F.col("_n") + 1) / 2) * ((F.col("_n") + 1) / 2)
    vx, vy = F.col("_xx") - square, F.col("_yy") - square
    return sums.select(*by, F.when((vx > 0) & (vy > 0), (F.col("_xy") - square) / F.sqrt(vx) / F.sqrt(vy)).alias("spearman"))

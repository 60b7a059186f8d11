"""Joins of long tables with small ones, and checks of key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_keyed(
    df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left", *, condition: Column | None = None
) -> DataFrame:
    """Equi-join on ``keys`` (+ ``condition``) that keeps the columns of ``df`` and those ``other`` adds.

    No hint: adaptive execution broadcasts a side that has turned out small and splits hot keys.
    """
    renamed = other
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_k_{k}")
    on = condition if condition is not None else F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return df.join(renamed, on, how).drop(*[f"_k_{k}" for k in keys])


def with_fps(df: DataFrame, fps: DataFrame, default: float = 25.0) -> DataFrame:
    """Per-video frame rate from a one-row-per-video table, with a default."""
    out = join_keyed(df, fps.select("video_id", "fps"), ["video_id"], "left")
    return out.withColumn("fps", F.coalesce(F.col("fps").cast("double"), F.lit(float(default))))


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, with ``side`` 'left' or 'right'."""
    a = left.select(*keys).distinct()
    b = right.select(*keys).distinct()
    missing_right = a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left"))
    missing_left = b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right"))
    return missing_right.unionByName(missing_left)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def entity_differences(
    tracks: DataFrame, expected: DataFrame, *, entity: str = "bird_id"
) -> DataFrame:
    """Per video whose ids differ from the expected ones: what is missing and what is extra.

    ``expected``: video_id and the entity. Distinct ids are taken map-side.
    """
    keys = ["video_id", entity]
    have, want = tracks.select(*keys).distinct(), expected.select(*keys).distinct()
    a = have.groupBy("video_id").agg(F.sort_array(F.collect_set(entity)).alias("_have"))
    b = want.groupBy("video_id").agg(F.sort_array(F.collect_set(entity)).alias("_want"))
    both = a.join(b, "video_id", "full")
    none = F.array().cast(have.select(F.array(entity)).schema[0].dataType)
    h, w = F.coalesce("_have", none), F.coalesce("_want", none)
    out = both.select("video_id", F.array_except(w, h).alias("missing"), F.array_except(h, w).alias("extra"))
    return out.filter((F.size("missing") > 0) | (F.size("extra") > 0))


class Findings(ValueError):
    """Rows that should not exist: ``table`` holds all of them, ``count`` tells how many."""

    def __init__(self, what: str, table: DataFrame, count: int):
        super().__init__(f"{count} {what}")
        self.table, self.count = table, count


def check_empty(df: DataFrame, what: str) -> None:
    """Raise :class:`Findings` if ``df`` has rows."""
    n = df.count()
    if n:
        raise Findings(what, df, n)

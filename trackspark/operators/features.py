"""Per-frame kinematics and per-window feature summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import stats
from trackspark.operators.blocks import BLOCK, Neighbours
from trackspark.operators.frames import pairwise_features

# The summarised features, in sequence order.
FEATURES = [
    "mask_area",
    "aspect_ratio",
    "velocity",
    "acceleration",
    "area_change_rate",
    "orientation_velocity",
    "solidity_change",
    "elongation_change",
    "turning_angle",
    "velocity_autocorr",
    "min_dist_to_other",
    "mean_dist_to_other",
    "dist_change_rate",
    "elongation",
    "orientation",
    "solidity",
    "eccentricity",
]
ENTITY = ["video_id", "bird_id"]
WINDOW = ["video_id", "bird_id", "window"]
MIN_SPEED = 1.0


def kinematics(spatial: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Add frame-to-frame changes per (video, bird) in frame order.

    "Previous" is the previous present row; two rows of a bird in one frame stand in the order
    of their centroids and areas. Shape changes are added for the shape columns
    the input has, ``dist_change_rate`` when it has ``min_dist_to_other``.
    """
    names = set(spatial.columns)
    tie = [c for c in ("centroid_x", "centroid_y", "mask_area") if c in names]
    nb = Neighbours(spatial, ENTITY, "frame_idx", tie=tie, back=2, block=block)
    prev = {c: nb.lag(c) for c in names if c not in (*ENTITY, "frame_idx")}
    vx = F.col("centroid_x") - prev["centroid_x"]
    vy = F.col("centroid_y") - prev["centroid_y"]
    vx1 = prev["centroid_x"] - nb.lag("centroid_x", 2)
    vy1 = prev["centroid_y"] - nb.lag("centroid_y", 2)
    staged = {"_vx": vx, "_vy": vy, "_ux": vx1, "_uy": vy1}
    if "mask_area" in names:
        p = prev["mask_area"]
        staged["area_change_rate"] = F.when(p > 0, (F.col("mask_area") - p) / p)
    for source, target in (
        ("orientation", "orientation_velocity"),
        ("solidity", "solidity_change"),
        ("elongation", "elongation_change"),
        ("min_dist_to_other", "dist_change_rate"),
    ):
        if source in names:
            staged[target] = F.col(source) - prev[source]
    vx, vy, ux, uy = (F.col(c) for c in ("_vx", "_vy", "_ux", "_uy"))
    speed, speed_before = F.sqrt(vx * vx + vy * vy), F.sqrt(ux * ux + uy * uy)
    angle = F.abs(F.atan2(ux * vy - uy * vx, ux * vx + uy * vy))
    slow = (F.col("velocity") < MIN_SPEED) | (F.col("_before_v") < MIN_SPEED)
    return (
        nb.with_columns(staged)
        .withColumns({"velocity": speed, "_before_v": speed_before})
        .withColumns(
            {
                "acceleration": F.col("velocity") - F.col("_before_v"),
                "turning_angle": F.when(~slow, angle),
                "velocity_autocorr": F.col("velocity") * F.col("_before_v"),
            }
        )
        .drop("_vx", "_vy", "_ux", "_uy", "_before_v")
    )


def frame_features(spatial: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """All per-frame features from the spatial table: neighbours first, then kinematics.

    The two steps carry all columns along, so the feature tables need no joins.
    """
    return kinematics(pairwise_features(spatial), block=block)


def summarise(
    features: DataFrame,
    *,
    names: Sequence[str] | None = None,
    aggs: dict[str, Callable[[Column], Column]] | None = None,
    keys: Sequence[str] = tuple(WINDOW),
    mad: bool = True,
) -> DataFrame:
    """One row per window: ``{feature}_{statistic}`` for every feature, plus ``n_frames``.

    ``aggs`` maps a statistic name to a function from column to aggregate and may hold user
    aggregates. The medians for the median absolute deviation are taken as a window over the
    same partitioning the aggregation uses: one exchange. Windows hold about a hundred frames
    (the coverage filter bounds them).
    """
    names = [f for f in (names or FEATURES) if f in features.columns]
    aggs = stats.SUMMARY if aggs is None else aggs
    keys = list(keys)
    # A part of the key set suffices for the exchange of both steps.
    rows = features.select(*keys, *[stats.finite(c).alias(c) for c in names]).repartition(*keys)
    if mad:
        whole = Window.partitionBy(*keys)
        rows = rows.withColumns({f"_med_{c}": F.percentile(F.col(c), F.lit(0.5)).over(whole) for c in names})
    out = []
    for c in names:
        for stat, fn in aggs.items():
            out.append(fn(F.col(c)).alias(f"{c}_{stat}"))
        if mad:
            deviation = F.abs(F.col(c) - F.col(f"_med_{c}"))
            out.append(F.percentile(deviation, F.lit(0.5)).alias(f"{c}_mad"))
    return rows.groupBy(*keys).agg(*out, F.count(F.lit(1)).alias("n_frames"))


def window_sequences(features: DataFrame, *, names: Sequence[str] | None = None) -> DataFrame:
    """Per window: the feature vectors in frame order (float, missing = 0)."""
    names = [f for f in (names or FEATURES) if f in features.columns]
    step = F.array(*[F.coalesce(stats.finite(c), F.lit(0.0)).cast("float") for c in names])
    ordered = F.array_sort(F.collect_list(F.struct("frame_idx", step.alias("v"))))
    return features.groupBy(*WINDOW).agg(F.transform(ordered, lambda s: s["v"]).alias("seq"))

"""Per-frame crowding and overlap metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackspark.functions import boxes as bx
from trackspark.operators import tiles
from trackspark.operators.blocks import BLOCK, Neighbours

FRAME = ("video_id", "frame_idx")


#: The foldable statistics, one column each.
STATS = "n long, n_dist long, min_dist double, sum_dist double, n_near long, max_iou double, sum_iou double, n_over long"


def _pair_sums(values: np.ndarray, first: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sum of each group's pairs: those of a first member are added up, then the members' sums from the last one.

    Small sums meet first, so fewer bits are lost than in one run over all pairs.
    """
    if not len(first):
        return np.zeros(n)
    member = np.bincount(first, values)
    of = np.zeros(len(member), np.int64)
    of[first] = group
    return np.bincount(of[::-1], member[::-1], minlength=n)


def pair_stats(
    iou: np.ndarray, dist: np.ndarray, group: np.ndarray, first: np.ndarray, n: int, *, iou_threshold: float, near: float
) -> dict[str, np.ndarray]:
    """``STATS`` of the pairs of many groups; a ``dist`` of NaN is NULL."""
    known = ~np.isnan(dist)
    max_iou, min_dist = np.zeros(n), np.full(n, bx.INF)
    np.maximum.at(max_iou, group, iou)
    np.minimum.at(min_dist, group[known], dist[known])
    count = lambda flag: np.bincount(group[flag], minlength=n)
    return {
        "n": np.bincount(group, minlength=n),
        "n_dist": count(known),
        "min_dist": min_dist,
        "sum_dist": _pair_sums(np.where(known, dist, 0.0), first, group, n),
        "n_near": count(dist < near),
        "max_iou": max_iou,
        "sum_iou": _pair_sums(iou, first, group, n),
        "n_over": count(iou > iou_threshold),
    }


def _box_pairs_folded(iou_threshold: float, near: float):
    """:func:`pair_stats` of boxes for :func:`tiles.fold_pairs`: all pairs of many frames at once (NaN is NULL)."""

    def fold(c: dict, group: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> dict[str, np.ndarray]:
        area = np.fmax((c["x2"] - c["x1"]) * (c["y2"] - c["y1"]), 0.0)
        shared = np.ones(len(i))
        for low, high in (("x1", "x2"), ("y1", "y2")):
            shared *= np.fmax(np.fmin(c[high][i], c[high][j]) - np.fmax(c[low][i], c[low][j]), 0.0)
        union = area[i] + area[j] - shared
        iou = np.divide(shared, union, out=np.zeros(len(i)), where=union > 0)
        dx, dy = c["cx"][i] - c["cx"][j], c["cy"][i] - c["cy"][j]
        return pair_stats(iou, np.sqrt(dx * dx + dy * dy), group, i, n, iou_threshold=iou_threshold, near=near)

    return fold


def _merge_parts(packed: DataFrame, keys: Sequence[str], summary: Column, more: Sequence[Column] = ()) -> DataFrame:
    """Bring the rows of a split group back together; ``more`` aggregates are named columns of the result."""
    rows = packed.withColumn("_p", summary)
    p = F.col("_p")
    rows = rows.groupBy(*keys).agg(
        F.struct(
            F.sum(p["n"]).alias("n"),
            F.sum(p["n_dist"]).alias("n_dist"),
            F.min(p["min_dist"]).alias("min_dist"),
            F.sum(p["sum_dist"]).alias("sum_dist"),
            F.sum(p["n_near"]).alias("n_near"),
            F.max(p["max_iou"]).alias("max_iou"),
            F.sum(p["sum_iou"]).alias("sum_iou"),
            F.sum(p["n_over"]).alias("n_over"),
        ).alias("_p"),
        *more,
    )
    extra = [c for c in rows.columns if c not in (*keys, "_p")]
    some, known = p["n"] > 0, p["n_dist"] > 0
    return rows.select(
        *keys,
        F.when(known, p["min_dist"]).otherwise(F.lit(bx.INF)).alias("min_centroid_distance"),
        F.when(known, p["sum_dist"] / p["n_dist"])
        .otherwise(F.lit(bx.INF))
        .alias("mean_centroid_distance"),
        F.when(some, p["n_near"] / p["n"]).otherwise(F.lit(0.0)).alias("clustering_coefficient"),
        p["max_iou"].alias("max_iou"),
        F.when(some, p["sum_iou"] / p["n"]).otherwise(F.lit(0.0)).alias("mean_iou"),
        p["n_over"].alias("num_overlapping_pairs"),
        *extra,
    )


def detection_frames(
    detections: DataFrame,
    *,
    iou_threshold: float = 0.15,
    cluster_distance: float = 0.15,
    min_objects: int = 3,
    min_separation: float = 0.15,
    normalised: bool = True,
    frame_spine: DataFrame | None = None,
    changes: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """Detector metrics, one row per (video, frame) with a detection.

    ``detections``: video_id, frame_idx, track_id, x1..y2, confidence and, for ``normalised``
    distances, cx_norm / cy_norm. With ``frame_spine`` (video_id, frame_idx) empty frames get
    a row as well. Without ``changes`` no frame is compared with the one before it. ``detections`` are read several
    times, so they should be a stored table.
    """
    b = bx.box()
    use_norm = normalised and "cx_norm" in detections.columns
    d = detections.select(
        *FRAME,
        "track_id",
        b.alias("box"),
        (F.col("cx_norm") if use_norm else bx.centre_x(b)).cast("double").alias("cx"),
        (F.col("cy_norm") if use_norm else bx.centre_y(b)).cast("double").alias("cy"),
        F.col("confidence").cast("double").alias("confidence"),
    )

    sides = [F.col("box")[c].alias(c) for c in ("x1", "y1", "x2", "y2")]
    flat = d.select(*FRAME, "track_id", *sides, "cx", "cy")
    member = [c for c in flat.columns if c not in FRAME]
    stats = StructType.fromDDL(STATS)
    packed = tiles.fold_pairs(flat, FRAME, member, _box_pairs_folded(iou_threshold, cluster_distance), stats)
    summary = F.struct(*stats.names)
    per_object = [
        F.count(F.lit(1)).alias("num_objects"),
        F.avg(bx.area(F.col("box"))).alias("mean_bbox_area"),
        F.min(bx.area(F.col("box"))).alias("min_bbox_area"),
        F.max(bx.area(F.col("box"))).alias("max_bbox_area"),
        F.var_pop(bx.area(F.col("box"))).alias("bbox_area_variance"),
        F.avg("confidence").alias("mean_confidence"),
    ]
    ids = F.sort_array(F.collect_set("track_id")).alias("objects_present")
    frames = d.groupBy(*FRAME).agg(*per_object, ids)
    out = frames.join(_merge_parts(packed, FRAME, summary), list(FRAME), "left")
    out = out.withColumnRenamed("max_iou", "max_pairwise_bbox_iou").withColumnRenamed(
        "mean_iou", "mean_pairwise_bbox_iou"
    )
    out = _fill_spine(out, frame_spine)
    out = out.withColumns(
        {
            "is_high_occlusion": (F.col("max_pairwise_bbox_iou") > iou_threshold)
            | (F.col("clustering_coefficient") > 0.5),
            "separation_score": bx.separation_score(
                F.col("num_objects"),
                F.col("min_centroid_distance"),
                F.col("clustering_coefficient"),
                F.col("num_overlapping_pairs"),
                min_objects=min_objects,
                min_separation=min_separation,
            ),
        }
    )
    return count_change(out, block=block) if changes else out


def _fill_spine(frames: DataFrame, spine: DataFrame | None) -> DataFrame:
    """Add rows for frames without objects: distances infinite, everything else 0."""
    if spine is None:
        return frames
    out = spine.select(*FRAME).distinct().join(frames, list(FRAME), "left")
    fills = {}
    for field in frames.schema:
        if field.name in FRAME:
            continue
        if field.name == "objects_present":
            empty = F.array().cast(field.dataType)
            fills[field.name] = F.coalesce(F.col(field.name), empty)
        elif field.name.endswith("centroid_distance"):
            fills[field.name] = F.coalesce(F.col(field.name), F.lit(bx.INF))
        else:
            fills[field.name] = F.coalesce(F.col(field.name), F.lit(0).cast(field.dataType))
    return out.withColumns(fills)


def count_change(frames: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Flag frames whose object count differs from the previous present frame."""
    nb = Neighbours(frames, ["video_id"], "frame_idx", back=1, block=block)
    prev = nb.lag("num_objects")
    return nb.with_columns(
        {"is_object_count_change": F.coalesce(prev != F.col("num_objects"), F.lit(False))}
    )


def pairwise_features(spatial: DataFrame, *, entity: str = "bird_id") -> DataFrame:
    """Add the distance of every object to the others in its frame and the nearest one's id.

    ``spatial`` needs video_id, frame_idx, the entity, centroid_x and centroid_y; its other
    columns travel along, so no join is needed. Objects without a centroid, or alone in their
    frame, get NULLs. Ties go to the lowest id.
    """
    keys = list(FRAME)
    rest = [c for c in spatial.columns if c not in (*keys, entity, "centroid_x", "centroid_y")]
    member = [entity, "centroid_x", "centroid_y", *rest]
    packed = tiles.pack(spatial, keys, member)
    items = F.col("items")
    whole = F.col("_pa") == F.col("_pb")
    start = F.struct(
        F.lit(None).cast("struct<d:double,id:%s>" % _type_of(spatial, entity)).alias("best"),
        F.lit(0.0).alias("total"),
        F.lit(0).cast("long").alias("n"),
    )

    def known(a: Column) -> Column:
        return a["centroid_x"].isNotNull() & a["centroid_y"].isNotNull()

    def measure(a: Column) -> Column:
        others = F.filter(
            items,
            lambda b: known(a)
            & known(b)
            & (b[entity] != a[entity])
            & (whole | (a["_part"] != b["_part"])),
        )

        def step(acc: Column, b: Column) -> Column:
            d = bx.distance(a["centroid_x"], a["centroid_y"], b["centroid_x"], b["centroid_y"])
            here = F.struct(d.alias("d"), b[entity].alias("id"))
            return F.struct(
                F.least(acc["best"], here).alias("best"),
                (acc["total"] + d).alias("total"),
                (acc["n"] + 1).alias("n"),
            )

        own = [a[c].alias(c) for c in member]
        return F.struct(*own, F.aggregate(others, start, step).alias("_m"))

    rows = packed.select(*keys, "_parts", F.inline(F.transform(items, measure)))
    m = F.col("_m")
    # A row stands in as many packed rows as its group has parts; equal rows stay as many as they were.
    copies = (F.count(F.lit(1)) / F.first("_parts")).cast("int").alias("_copies")
    rows = rows.groupBy(*keys, *member).agg(
        F.struct(
            F.min(m["best"]).alias("best"), F.sum(m["total"]).alias("total"), F.sum(m["n"]).alias("n")
        ).alias("_m"),
        copies,
    )
    rows = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).drop("_copy", "_copies")
    return rows.withColumns(
        {
            "min_dist_to_other": m["best"]["d"],
            "mean_dist_to_other": F.when(m["n"] > 0, m["total"] / m["n"]),
            "nearest_neighbor_id": m["best"]["id"],
        }
    ).drop("_m")


def _type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()

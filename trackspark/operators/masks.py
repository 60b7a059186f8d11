"""Mask operators over tables with ``counts`` (compressed runs) and ``size`` [height, width]."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from trackspark.functions import boxes as bx
from trackspark.functions import rle
from trackspark.operators import tiles
from trackspark.operators.blocks import BLOCK
from trackspark.operators.frames import FRAME, STATS, _fill_spine, _merge_parts, count_change, pair_stats


def height() -> Column:
    return F.get("size", F.lit(0))


def spatial_features(tracks: DataFrame) -> DataFrame:
    """Key columns plus mask geometry, box area and aspect ratio: one pass, no shuffle."""
    b = bx.box_from_array("bbox")
    keep = [c for c in ("window",) if c in tracks.columns]
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return tracks.select(
        "video_id",
        "bird_id",
        "frame_idx",
        *keep,
        rle.mask_geometry("counts", height()).alias("g"),
        (w * h).alias("bbox_area"),
        bx.aspect_ratio(b).alias("aspect_ratio"),
    ).select(
        "video_id", "bird_id", "frame_idx", *keep, "bbox_area", "aspect_ratio", "g.*"
    ).drop("box")


def mask_boxes(masks: DataFrame) -> DataFrame:
    """Add ``mask_box`` [x1, y1, x2, y2] with inclusive maxima; zeros for an empty mask."""
    return masks.withColumn("mask_box", rle.mask_box("counts", height()))


def drop_empty(masks: DataFrame) -> DataFrame:
    """Rows whose mask has at least one pixel."""
    return masks.filter(rle.mask_area("counts") > 0)


def _packed(masks: DataFrame, entity: str, extra: list[str]) -> DataFrame:
    rows = masks.select(*FRAME, F.col(entity).cast("long").alias("id"), "counts", *extra)
    packed = tiles.pack(rows, FRAME, ["id", *extra, "counts"])
    pick = lambda name: F.transform("items", lambda i: i[name])
    place = F.transform("items", lambda _, k: k.cast("long"))  # an id may occur twice in a frame
    return packed.withColumn(
        "_pairs",
        rle.mask_pairs(place, pick("counts"), pick("_part"), F.col("_pa") == F.col("_pb")),
    )


def _at(place: Column) -> Column:
    return F.get(F.col("items"), place.cast("int"))


def _iou(p: Column) -> Column:
    union = p["area_a"] + p["area_b"] - p["inter"]
    return F.when(union > 0, p["inter"] / union).otherwise(F.lit(0.0))


def mask_overlaps(
    masks: DataFrame, *, entity: str = "tracking_id", threshold: float = 0.0
) -> DataFrame:
    """Pairs of one frame with mask IoU >= ``threshold``: video_id, frame_idx, id_a < id_b, iou."""
    scored = F.transform(
        "_pairs",
        lambda p: F.struct(
            F.least(_at(p["ia"])["id"], _at(p["ib"])["id"]).alias("id_a"),
            F.greatest(_at(p["ia"])["id"], _at(p["ib"])["id"]).alias("id_b"),
            _iou(p).alias("iou"),
        ),
    )
    kept = F.filter(scored, lambda s: s["iou"] >= threshold)
    return _packed(masks, entity, []).select(*FRAME, F.inline(kept))


#: Measures of the masks of a frame or of a part of it, one column each; ``sq_area`` is whole, so that parts add up exactly.
OBJECTS = "objects long, ids array<bigint>, n_area long, sum_area long, sq_area long, min_area double, max_area double"


def _masks_folded(iou_threshold: float, near: float):
    """For :func:`tiles.fold_pairs`: the masks of many frames are decoded once for their sizes, centres and pairs."""

    def fold(c: dict, group: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> dict:
        counts, of = c["counts"], c["_group"]
        runs = rle.ranges(counts)
        area, cx, cy = rle.centres(*runs, np.nan_to_num(c["height"], nan=1).astype(np.int64))
        known = counts.is_valid().to_numpy(zero_copy_only=False)
        both = known[i] & known[j]
        i, j, group = i[both], j[both], group[both]
        shared = rle.shared_pixels(*runs, of, i, j)
        union = area[i] + area[j] - shared
        iou = np.divide(shared, union, out=np.zeros(len(i)), where=union > 0)
        dx, dy = cx[i] - cx[j], cy[i] - cy[j]
        pairs = pair_stats(iou, np.sqrt(dx * dx + dy * dy), group, i, n, iou_threshold=iou_threshold, near=near)
        # A frame's ids stand in order.
        named = np.flatnonzero(c["_own"] & c["id"].is_valid().to_numpy(zero_copy_only=False))
        ids = c["id"].take(pa.array(named))
        new = np.append(True, (np.diff(of[named]) != 0) | (np.diff(ids.to_numpy()) != 0))[: len(named)]
        ends = np.append(0, np.cumsum(np.bincount(of[named[new]], minlength=n)))
        own = c["_own"] & known
        at, size = of[own], area[own].astype(np.int64)
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(low, at, size)
        np.maximum.at(high, at, size)
        total, squares = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(total, at, size)
        np.add.at(squares, at, size * size)
        none = np.isinf(low)
        return pairs | {
            "objects": np.bincount(of[c["_own"]], minlength=n),
            "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids.filter(pa.array(new))),
            "n_area": np.bincount(at, minlength=n),
            "sum_area": total,
            "sq_area": squares,
            "min_area": np.where(none, np.nan, low),
            "max_area": np.where(none, np.nan, high),
        }

    return fold


def _area_spread() -> Column:
    """Population variance from whole sums, which are multiplied without rounding."""
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    squares = whole("_n") * whole("_sq") - whole("_sum") * whole("_sum")
    return squares.cast("double") / (F.col("_n").cast("double") * F.col("_n"))


def mask_frames(
    masks: DataFrame,
    *,
    entity: str = "tracking_id",
    iou_threshold: float = 0.15,
    cluster_distance: float = 50.0,
    frame_spine: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Crowding metrics per frame from masks, in pixels. Empty masks have no centroid and
    take no part in distances."""
    kind = masks.schema[entity].dataType
    rows = masks.select(*FRAME, F.col(entity).cast("long").alias("id"), "counts", height().alias("height"))
    stats = StructType.fromDDL(f"{STATS}, {OBJECTS}")
    fold = _masks_folded(iou_threshold, cluster_distance)
    folded = tiles.fold_pairs(rows, FRAME, ["id", "counts", "height"], fold, stats, raw=("id", "counts"))
    objects = [
        F.sum("objects").alias("num_objects"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).cast(ArrayType(kind)).alias("objects_present"),
        F.min("min_area").alias("min_mask_area"),
        F.max("max_area").alias("max_mask_area"),
        F.sum("n_area").alias("_n"),
        F.sum("sum_area").alias("_sum"),
        F.sum("sq_area").alias("_sq"),
    ]
    out = _merge_parts(folded, FRAME, F.struct(*StructType.fromDDL(STATS).names), objects)
    out = out.withColumns({"mean_mask_area": F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")), "mask_area_variance": F.when(F.col("_n") > 0, _area_spread())})
    # Rows without a video or a frame have no pairs.
    area = rle.mask_area("counts").cast("double")
    lost = rows.filter(F.greatest(*[F.col(k).isNull() for k in FRAME])).withColumn("area", area).groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("num_objects"),
        F.sort_array(F.collect_set("id")).cast(ArrayType(kind)).alias("objects_present"),
        F.avg("area").alias("mean_mask_area"),
        F.min("area").alias("min_mask_area"),
        F.max("area").alias("max_mask_area"),
        F.var_pop("area").alias("mask_area_variance"),
    )
    out = out.drop("_n", "_sum", "_sq").unionByName(lost, allowMissingColumns=True)
    out = out.withColumnRenamed("max_iou", "max_pairwise_mask_iou").withColumnRenamed(
        "mean_iou", "mean_pairwise_mask_iou"
    )
    out = _fill_spine(out, frame_spine)
    high = (F.col("max_pairwise_mask_iou") > iou_threshold) | (F.col("clustering_coefficient") > 0.5)
    return count_change(out.withColumn("is_high_occlusion", high), block=block)


def match_ids_across_chunks(
    pairs: DataFrame, ids: DataFrame, *, keys: list[str] = ["video_id", "chunk_idx"], threshold: float = 0.10
) -> DataFrame:
    """Greedy one-to-one matching of new ids to previous ids by overlap, best pair first.

    ``pairs``: keys, new_id, prev_id, iou; ``ids``: keys, new_id (every new id). Unmatched ids
    keep their value, or take a fresh one when it is already taken. Equal overlaps are taken
    in (new_id, prev_id) order. The folds run over the handful of ids of one boundary.
    """
    cand = pairs.filter(F.col("iou") >= threshold).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("o"), "new_id", "prev_id"))).alias("_c")
    )
    base = ids.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col("new_id").cast("long"))).alias("_ids"))
    rows = base.join(cand, keys, "left")
    none = F.array().cast("array<struct<n:bigint,p:bigint>>")

    def pick(taken: Column, c: Column) -> Column:
        n, p = c["new_id"].cast("long"), c["prev_id"].cast("long")
        free = ~F.exists(taken, lambda t: (t["n"] == n) | (t["p"] == p))
        return F.when(free, F.concat(taken, F.array(F.struct(n.alias("n"), p.alias("p"))))).otherwise(taken)

    matched = F.when(F.col("_c").isNull(), none).otherwise(F.aggregate("_c", none, pick))
    rows = rows.withColumn("_m", matched)
    highest = F.array_max(F.concat("_ids", F.transform("_m", lambda t: t["p"])))
    start = F.struct(F.col("_m").alias("m"), (highest + 1).alias("fresh"))

    def settle(acc: Column, n: Column) -> Column:
        done = F.exists(acc["m"], lambda t: t["n"] == n)
        taken = F.exists(acc["m"], lambda t: t["p"] == n)
        value = F.when(taken, acc["fresh"]).otherwise(n)
        grown = F.concat(acc["m"], F.array(F.struct(n.alias("n"), value.alias("p"))))
        nxt = acc["fresh"] + F.when(taken, F.lit(1)).otherwise(F.lit(0))
        return F.when(done, acc).otherwise(F.struct(grown.alias("m"), nxt.cast("long").alias("fresh")))

    settled = F.aggregate("_ids", start, settle)["m"]
    return rows.select(*keys, F.inline(settled)).select(
        *keys, F.col("n").alias("new_id"), F.col("p").alias("mapped_id")
    )

"""Track lifecycle quality: per id, per run and per video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions import boxes as bx
from trackspark.operators import blocks, tiles
from trackspark.operators.blocks import BLOCK, Neighbours

ID = ["video_id", "tracking_id"]


def _boxes(tracks: DataFrame) -> DataFrame:
    """video_id, tracking_id, frame_idx, box and the scores a table has."""
    cols = tracks.columns
    b = bx.box_from_array("bbox") if "bbox" in cols else bx.box()
    extra = [c for c in ("scores", "tracker_score") if c in cols]
    return tracks.select(*ID, "frame_idx", b.alias("box"), *extra)


def _frame_counts(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("video_id", "frame_idx").agg(F.count(F.lit(1)).alias("_n"))


def presence(tracks: DataFrame, *, low_count: int = 3, block: int = BLOCK) -> DataFrame:
    """Rows with what the lifecycle tables need: run start, box overlap with the id's previous
    present row, and whether the frame holds fewer than ``low_count`` objects."""
    rows = _boxes(tracks).join(
        _frame_counts(tracks).select(
            "video_id", "frame_idx", (F.col("_n") < low_count).alias("is_low")
        ),
        ["video_id", "frame_idx"],
    )
    nb = Neighbours(rows, ID, "frame_idx", back=1, block=block)
    seen = nb.with_columns({"_box": nb.lag("box"), "_f": nb.lag("frame_idx")})
    seen = seen.withColumns(
        {
            "self_iou": F.when(F.col("_box").isNotNull(), bx.iou(F.col("_box"), F.col("box"))),
            "gap": F.col("frame_idx") - F.col("_f") - 1,
        }
    ).drop("_box", "_f")
    return blocks.with_runs(seen, ID, "frame_idx", block=block)


def run_metrics(rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """One row per contiguous run of an id (input: :func:`presence`)."""
    cols = rows.columns
    inner = F.col("frame_idx") > F.col("run_start")
    aggs = [
        F.max("frame_idx").alias("last_frame"),
        F.count(F.lit(1)).alias("length"),
        F.count_if("is_low").alias("low_count_total"),
        F.avg(F.when(inner, F.col("self_iou"))).alias("mean_iou"),
        F.avg(bx.area(F.col("box"))).alias("mean_bbox_area"),
    ]
    for source, name in (("scores", "mean_score"), ("tracker_score", "mean_tracker_score")):
        if source in cols:
            aggs.append(F.avg(source).alias(name))
    out = rows.groupBy(*ID, F.col("run_start").alias("first_frame")).agg(*aggs)
    out = out.withColumn("low_count_fraction", F.col("low_count_total") / F.col("length"))
    return blocks.row_index(out, ID, "first_frame", "run_idx", block=block)


def spatial_continuity(
    tracks: DataFrame, *, iou_threshold: float = 0.5, block: int = BLOCK
) -> DataFrame:
    """Per id: mean of the best overlap with any box of the next present frame, where >= threshold.

    Boxes of the next frame may serve several boxes: nothing is marked as used here.
    """
    best = _next_frame_pairs(tracks, iou_threshold, block).groupBy(*ID, "frame_idx").agg(
        F.max("iou").alias("iou")
    )
    return best.groupBy(*ID).agg(F.avg("iou").alias("spatial_continuity_iou"))


def _next_frame_pairs(
    tracks: DataFrame, iou_threshold: float, block: int
) -> DataFrame:
    """Overlapping boxes of consecutive present frames: (video, frame, id, next_id, iou >= thr).

    Each part of a frame (usually the whole frame) meets each part of the next one in a row of
    its own; the pair test happens inside that row and only the few overlapping pairs come out.
    """
    rows = _boxes(tracks).select("video_id", "frame_idx", F.col("tracking_id").alias("id"), "box")
    keys = ["video_id", "frame_idx"]
    frames = tiles.parts_of(rows, keys)
    nb = Neighbours(frames, ["video_id"], "frame_idx", ahead=1, block=block)
    follows = nb.with_columns({"next_frame": nb.lead("frame_idx")}).drop("_parts")
    parts = (
        rows.join(frames, keys)
        .withColumn("_part", tiles.part_of(["id", "box"]))
        .groupBy(*keys, "_part")
        .agg(F.sort_array(F.collect_list(F.struct("id", "box"))).alias("items"))
    )
    following = parts.select(
        "video_id", F.col("frame_idx").alias("next_frame"), F.col("items").alias("next_items")
    )
    both = parts.join(follows, keys).join(following, ["video_id", "next_frame"])

    def matches(a: Column) -> Column:
        scored = F.transform(
            F.col("next_items"),
            lambda b: F.struct(
                a["id"].alias("tracking_id"),
                b["id"].alias("next_id"),
                bx.iou(a["box"], b["box"]).alias("iou"),
            ),
        )
        return F.filter(scored, lambda s: s["iou"] >= iou_threshold)

    return both.filter(F.col("next_items").isNotNull()).select(
        *keys, F.inline(F.flatten(F.transform("items", matches)))
    )


def greedy_matches(
    tracks: DataFrame, *, iou_threshold: float = 0.5, block: int = BLOCK
) -> DataFrame:
    """One-to-one box matching of consecutive present frames, ids ascending.

    Each box takes the best box of the next frame that is not taken yet. A pair below the
    threshold can never match, so the fold runs over the overlapping pairs only.
    """
    pairs = _next_frame_pairs(tracks, iou_threshold, block)
    choice = F.struct(
        F.col("tracking_id").alias("a"), (-F.col("iou")).alias("o"), F.col("next_id").alias("b")
    )
    per_frame = pairs.groupBy("video_id", "frame_idx").agg(
        F.sort_array(F.collect_list(choice)).alias("c")
    )
    id_type = tracks.schema["tracking_id"].dataType.simpleString()
    start = F.array().cast(f"array<struct<a:{id_type},b:{id_type},o:double>>")

    def step(taken: Column, c: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["a"] == c["a"]) | (t["b"] == c["b"]))
        mine = F.struct(c["a"].alias("a"), c["b"].alias("b"), c["o"].alias("o"))
        return F.when(free, F.concat(taken, F.array(mine))).otherwise(taken)

    return per_frame.select(
        "video_id", "frame_idx", F.inline(F.aggregate("c", start, step))
    ).select(
        "video_id",
        "frame_idx",
        F.col("a").alias("tracking_id"),
        F.col("b").alias("next_id"),
        (-F.col("o")).alias("iou"),
        (F.col("a") != F.col("b")).alias("is_switch"),
    )


def id_metrics(
    tracks: DataFrame,
    *,
    low_count: int = 3,
    iou_threshold: float = 0.5,
    block: int = BLOCK,
    rows: DataFrame | None = None,
) -> DataFrame:
    """One row per (video, id): span, runs, gaps, low-count frames, overlaps, mean area."""
    rows = presence(tracks, low_count=low_count, block=block) if rows is None else rows
    out = rows.groupBy(*ID).agg(
        F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"),
        F.count(F.lit(1)).alias("length"),
        F.count_if(F.col("run_start") == F.col("frame_idx")).alias("runs"),
        F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("gaps_total"),
        F.count_if("is_low").alias("low_count_total"),
        F.avg("self_iou").alias("self_iou"),
        F.avg(bx.area(F.col("box"))).alias("mean_bbox_area"),
    )
    span = (F.col("last_frame") - F.col("first_frame") + 1).cast("long")
    out = out.withColumns({"span": span}).withColumns(
        {
            "coverage": F.col("length") / F.col("span"),
            "low_count_fraction": F.col("low_count_total") / F.col("span"),
        }
    )
    near = spatial_continuity(tracks, iou_threshold=iou_threshold, block=block)
    return out.join(near, ID, "left")


def continuity(tracks: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Per video: detections that could persist to the next present frame, and those that did."""
    keys = ["video_id", "frame_idx"]
    packed = tracks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("tracking_id").alias("ids")
    )
    nb = Neighbours(packed, ["video_id"], "frame_idx", ahead=1, block=block)
    both = nb.with_columns({"_next": nb.lead("ids")}).filter(F.col("_next").isNotNull())
    return both.groupBy("video_id").agg(
        F.sum("n").alias("transitions_possible"),
        F.sum(F.size(F.array_intersect("ids", "_next"))).alias("transitions_preserved"),
    )


def video_summary(
    tracks: DataFrame,
    *,
    persistence_k: int = 5,
    low_count: int = 3,
    iou_threshold: float = 0.5,
    frame_spine: DataFrame | None = None,
    switch_events: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """One row per video with the usual tracking proxies.

    ``frame_spine`` (video_id, frame_idx) counts frames without objects as well;
    ``switch_events`` adds occlusion-aware switch counts.
    """
    ids = id_metrics(tracks, low_count=low_count, iou_threshold=iou_threshold, block=block)
    per_id = ids.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total_unique_ids"),
        F.avg("length").alias("mean_track_length"),
        F.avg((F.col("length") >= persistence_k).cast("double")).alias("persistence_rate"),
        F.avg("runs").alias("mean_fragmentation_runs_per_id"),
        F.avg("coverage").alias("mean_coverage_per_id"),
        F.avg("self_iou").alias("mean_per_id_iou"),
    )
    counts = _frame_counts(tracks)
    if frame_spine is not None:
        counts = frame_spine.select("video_id", "frame_idx").distinct().join(
            counts, ["video_id", "frame_idx"], "left"
        )
    n = F.coalesce("_n", F.lit(0))
    frames = counts.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.avg(n).alias("avg_detections_per_frame"),
        F.count_if(n < low_count).alias("low_frame_count"),
    )
    greedy = greedy_matches(tracks, iou_threshold=iou_threshold, block=block)
    matched = greedy.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("iou_match_count"), F.count_if("is_switch").alias("id_switches")
    )
    out = (
        frames.join(per_id, "video_id", "left")
        .join(continuity(tracks, block=block), "video_id", "left")
        .join(matched, "video_id", "left")
    )
    zero = ["transitions_possible", "transitions_preserved", "iou_match_count", "id_switches"]
    zero += ["total_unique_ids"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in zero})
    matches = F.greatest(F.col("iou_match_count"), F.lit(1))
    out = out.withColumns(
        {
            "continuity_fraction": F.col("transitions_preserved")
            / F.greatest(F.col("transitions_possible"), F.lit(1)),
            "id_switch_rate": F.col("id_switches") / matches,
            "low_frame_fraction": F.col("low_frame_count") / F.col("n_frames"),
        }
    ).drop("transitions_possible", "transitions_preserved")
    if switch_events is not None:
        events = switch_events.groupBy("video_id").agg(
            F.count(F.lit(1)).alias("occlusion_aware_id_switches")
        )
        out = out.join(events, "video_id", "left").withColumn(
            "occlusion_aware_id_switches", F.coalesce("occlusion_aware_id_switches", F.lit(0)).cast("long")
        )
        out = out.withColumn(
            "occlusion_aware_id_switch_rate", F.col("occlusion_aware_id_switches") / matches
        )
    return out

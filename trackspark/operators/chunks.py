"""Video chunking: fixed, manual and adaptive boundaries, keyframe schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import boxes as bx
from trackspark.operators.blocks import ordered_fold

TAIL_SHARE = 0.1


def fixed_chunks(videos: DataFrame, *, chunk_seconds: float = 60.0) -> DataFrame:
    """(video_id, chunk_idx, start, end, model_type) from (video_id, fps, total_frames).

    A tail shorter than a tenth of a chunk joins the chunk before it, unless that is chunk 0.
    """
    v = videos.select(
        "video_id",
        F.col("total_frames").cast("long").alias("total"),
        (F.col("fps") * F.lit(float(chunk_seconds))).cast("int").cast("long").alias("c"),
    )
    i, c, total = F.col("chunk_idx").cast("long"), F.col("c"), F.col("total")
    n = F.greatest(F.ceil(total / c), F.lit(1)).cast("long")
    spread = v.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    spread = spread.withColumns({"start": i * c, "end": F.least((i + 1) * c, total)})
    left = total - F.col("end")
    absorbs = (i > 0) & (left > 0) & (left < c * F.lit(TAIL_SHARE))
    absorbed = (i > 1) & (F.col("end") - F.col("start") < c * F.lit(TAIL_SHARE))
    return (
        spread.withColumn("end", F.when(absorbs, total).otherwise(F.col("end")))
        .filter(~absorbed)
        .select(
            "video_id",
            F.col("chunk_idx").cast("int").alias("chunk_idx"),
            "start",
            "end",
            F.when(F.col("chunk_idx") == 0, F.lit("video")).otherwise(F.lit("tracker")).alias("model_type"),
        )
    )


def manual_chunks(pairs: DataFrame) -> DataFrame:
    """Chunks from (video_id, ranges array<array<int>>, tracker_idx array<int>)."""
    out = pairs.select("video_id", "tracker_idx", F.posexplode("ranges").alias("chunk_idx", "r"))
    forced = F.array_contains(F.coalesce("tracker_idx", F.array().cast("array<int>")), F.col("chunk_idx"))
    kind = F.when(forced | (F.col("chunk_idx") > 0), F.lit("tracker")).otherwise(F.lit("video"))
    return out.select(
        "video_id",
        "chunk_idx",
        F.get("r", F.lit(0)).cast("long").alias("start"),
        F.get("r", F.lit(1)).cast("long").alias("end"),
        kind.alias("model_type"),
    )


def clip_chunks(chunks: DataFrame, videos: DataFrame) -> DataFrame:
    """Drop chunks past the end of the video and cut the last one."""
    total = videos.select("video_id", F.col("total_frames").cast("long").alias("_t"))
    out = chunks.join(total, "video_id").filter(F.col("start") < F.col("_t"))
    return out.withColumn("end", F.least("end", "_t")).drop("_t")


def choose_chunks(*sources: DataFrame) -> DataFrame:
    """First source (reuse, manual, adaptive, fixed, ...) that has chunks for a video wins."""
    tagged = None
    for rank, s in enumerate(sources):
        s = s.select("video_id", "chunk_idx", "start", "end", "model_type").withColumn("_rank", F.lit(rank))
        tagged = s if tagged is None else tagged.unionByName(s)
    best = tagged.groupBy("video_id").agg(F.min("_rank").alias("_rank"))
    return tagged.join(best, ["video_id", "_rank"]).drop("_rank")


def _records(flag: Column, value: Column) -> Column:
    """Keep a candidate only if no earlier frame of its boundary is at least as good.

    The limit towards the previous boundary favours earlier frames, so the others can never
    be chosen.
    """
    w = Window.partitionBy("video_id", "chunk_idx").orderBy("frame_idx")
    best = F.max(F.when(flag, value)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return flag & (best.isNull() | (value > best))


def adaptive_chunks(
    frames: DataFrame,
    videos: DataFrame,
    *,
    chunk_seconds: float = 60.0,
    search_seconds: float = 10.0,
    max_seconds: float = 150.0,
) -> DataFrame:
    """Move chunk boundaries to the best separated frame near each nominal cut.

    Candidates within the search radius are cut down to those that beat every earlier one
    (a window per boundary), then one ordered scan per video settles the boundaries: each
    depends on the one before through the length limit. A boundary with no separated frame,
    or whose best frame is the nominal one, falls back to the least overlapping frame.
    """
    fixed = fixed_chunks(videos, chunk_seconds=chunk_seconds)
    v = videos.select("video_id", F.col("fps").cast("double").alias("fps"), "total_frames")
    nominal = fixed.join(v, "video_id").select(
        "video_id",
        "chunk_idx",
        "start",
        "end",
        F.col("total_frames").cast("long").alias("total"),
        (F.col("fps") * F.lit(float(chunk_seconds))).cast("int").alias("c"),
        (F.col("fps") * F.lit(float(search_seconds))).cast("int").alias("radius"),
        (F.col("fps") * F.lit(float(max_seconds))).cast("int").alias("longest"),
)
    w = Window.partitionBy("video_id").orderBy("chunk_idx")
    whole = Window.partitionBy("video_id")
    nominal = nominal.withColumns(
        {
            "video_end": F.max("end").over(whole),
            "is_last": F.lead("start").over(w).isNull(),
            "next_start": F.coalesce(F.lead("start").over(w), F.max("end").over(whole)),
        }
    ).drop("end", "total")
    # The search interval in frames, keyed by nominal chunk length: an equi-join on the bucket
    # of the frame instead of a range join.
    bounds = nominal.filter(F.col("chunk_idx") > 0)
    span = F.sequence(
        F.floor((F.col("start") - F.col("radius")) / F.col("c")),
        F.floor((F.col("start") + F.col("radius")) / F.col("c")),
    )
    keyed = bounds.withColumn("_bucket", F.explode(span))
    lengths = v.select("video_id", (F.col("fps") * F.lit(float(chunk_seconds))).cast("int").alias("_c"))
    f = (
        frames.select(
            "video_id",
            F.col("frame_idx").cast("long").alias("frame_idx"),
            "separation_score",
            "num_objects",
            "max_pairwise_bbox_iou",
            "min_centroid_distance",
        )
        .join(lengths, "video_id")
        .withColumn("_bucket", F.floor(F.col("frame_idx") / F.col("_c")))
        .drop("_c")
    )
    lo = F.greatest(F.lit(0), F.col("start") - F.col("radius"))
    hi = F.least("video_end", F.col("start") + F.col("radius"))
    # The limit towards the nominal next boundary is known now; the one towards the previous
    # boundary is not, but it can only favour earlier frames.
    reaches_next = F.col("next_start") - F.col("frame_idx") <= F.col("longest")
    dist = F.when(F.col("min_centroid_distance") < F.lit(bx.INF), F.col("min_centroid_distance"))
    near = (
        f.join(keyed.drop("c"), ["video_id", "_bucket"])
        .filter(F.col("frame_idx").between(lo, hi) & reaches_next)
        .withColumn("fb", F.struct((-F.col("max_pairwise_bbox_iou")).alias("o"), F.coalesce(dist, F.lit(0.0)).alias("d")))
        .withColumn("is_fb", F.col("num_objects") >= 2)
    )
    kept = near.withColumns(
        {
            "_sep": _records(F.col("separation_score") > 0, F.col("separation_score")),
            "_fb": _records(F.col("is_fb"), F.col("fb")),
        }
    ).filter(F.col("_sep") | F.col("_fb"))
    lists = kept.groupBy("video_id", "chunk_idx").agg(
        F.sort_array(
            F.collect_list(F.when(F.col("_sep"), F.struct((-F.col("separation_score")).alias("k"), "frame_idx")))
        ).alias("sep"),
        F.sort_array(
            F.collect_list(
                F.when(
                    F.col("_fb"),
                    F.struct((-F.col("fb.o")).alias("k"), (-F.col("fb.d")).alias("k2"), "frame_idx"),
                )
            )
        ).alias("fb"),
    )
    ready = (
        nominal
        .join(lists, ["video_id", "chunk_idx"], "left")
        .select(
            "video_id", "chunk_idx", "start", "longest", "c", "is_last", "video_end",
            F.transform("sep", lambda s: s["frame_idx"]).alias("sep"),
            F.transform("fb", lambda s: s["frame_idx"]).alias("fb"),
        )
    )

    def step(row: dict, prev: dict | None):
        start = int(row["start"])
        if prev is not None:
            allowed = lambda f: (f - prev["at"]) <= row["longest"]
            pick = lambda xs: next((int(f) for f in (xs if xs is not None else ()) if allowed(f)), None)
            best = pick(row["sep"])
            if best is None or best == start:
                best = pick(row["fb"])
            start = start if best is None else best
        out = []
        here = {"at": start, "idx": int(row["chunk_idx"]), "type": "video" if prev is None else "tracker"}
        tail = row["is_last"] and prev is not None and row["video_end"] - start < row["c"] * TAIL_SHARE
        if prev is not None:
            end = int(row["video_end"]) if tail else start
            out.append((row["video_id"], prev["idx"], prev["at"], end, prev["type"]))
        if row["is_last"] and not tail:
            out.append((row["video_id"], here["idx"], start, int(row["video_end"]), here["type"]))
        return here, out

    return ordered_fold(
        ready,
        ["video_id"],
        ["chunk_idx"],
        step,
        "video_id string, chunk_idx int, start long, end long, model_type string",
    )


def boundaries(chunk_info: DataFrame) -> DataFrame:
    """Transition metadata of every chunk but the first (chunk rows: video, idx, start, end, ...)."""
    w = Window.partitionBy("video_id").orderBy("chunk_idx")
    out = chunk_info.withColumn("prev_chunk_end", F.lag("end").over(w) - 1)
    return out.filter(F.col("prev_chunk_end").isNotNull()).withColumnRenamed("start", "boundary_frame")


def chunk_throughput(chunk_info: DataFrame) -> DataFrame:
    """Frames, seconds and rates per video over exploded chunk info (num_frames, elapsed_seconds)."""
    g = chunk_info.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum("num_frames").alias("num_frames"),
        F.sum("elapsed_seconds").alias("elapsed_seconds"),
    )
    return g.withColumns(
        {
            "seconds_per_frame": F.col("elapsed_seconds") / F.col("num_frames"),
            "fps": F.col("num_frames") / F.col("elapsed_seconds"),
        }
    )


def border_points(points: DataFrame, width: int, height: int, *, margin: int) -> DataFrame:
    """Share of prompt points near the frame edge: (video_id, chunk_idx, x, y) rows."""
    x, y = F.col("x"), F.col("y")
    edge = (x < margin) | (x > width - margin) | (y < margin) | (y > height - margin)
    out = points.groupBy("video_id", "chunk_idx").agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(edge).alias("n_border")
    )
    return out.withColumn("border_share", F.col("n_border") / F.greatest("n_points", F.lit(1)))


# Keyframe offsets around chunk boundaries and occlusion periods.
BOUNDARY_OFFSETS = (-5, 0, 5)
OCCLUSION_PAD = 3


def longest_periods(periods: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` longest periods per video; the earlier one wins ties.

    A bounded top-k aggregation: per (video, salt) first, so no video's periods meet in one task.
    """
    length = F.col("end_frame") - F.col("start_frame")
    salted = periods.withColumn("_salt", F.pmod(F.xxhash64("start_frame"), F.lit(64)))
    w1 = Window.partitionBy("video_id", "_salt").orderBy(length.desc(), "start_frame")
    few = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    w2 = Window.partitionBy("video_id").orderBy(length.desc(), "start_frame")
    return few.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k).drop("_r", "_salt")


def keyframe_schedule(
    chunks: DataFrame, periods: DataFrame, videos: DataFrame, *, uniform_seconds: float = 30.0
) -> DataFrame:
    """Annotation frames per video: boundary frames, occlusion brackets, a uniform backbone.

    Sources claim frames in that order of priority. ``periods`` are the chosen (top) ones.
    """
    total = videos.select("video_id", "fps", F.col("total_frames").cast("long").alias("_t"))
    guided = chunks.filter(F.col("chunk_idx") > 0).select(
        "video_id",
        F.explode(F.array(*[F.col("start") + o for o in BOUNDARY_OFFSETS])).alias("frame_idx"),
        F.lit(0).alias("p"),
    )
    a, b = F.col("start_frame").cast("long"), F.col("end_frame").cast("long")
    marks = [a - OCCLUSION_PAD, a, F.floor((a + b) / 2), b, b + OCCLUSION_PAD]
    bracket = periods.select(
        "video_id", F.explode(F.array(*marks)).alias("frame_idx"), F.lit(1).alias("p")
    )
    # Nearest whole number of frames, halves to even.
    every = F.bround(F.col("fps") * F.lit(float(uniform_seconds)), 0).cast("long")
    uniform = total.filter(F.col("_t") > 0).select(
        "video_id",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_t") - 1, every)).alias("frame_idx"),
        F.lit(2).alias("p"),
    )
    names = F.array(F.lit("chunk_guided"), F.lit("occlusion_bracketing"), F.lit("uniform"))
    allf = guided.unionByName(bracket).unionByName(uniform).join(total.drop("fps"), "video_id")
    inside = F.col("frame_idx").between(F.lit(0), F.col("_t") - 1)
    return (
        allf.filter(inside)
        .groupBy("video_id", "frame_idx")
        .agg(F.min("p").alias("p"))
        .select("video_id", "frame_idx", F.get(names, F.col("p")).alias("source"))
    )


def schedule_summary(schedule: DataFrame) -> DataFrame:
    """Keyframes per video and source, with each source's percentage."""
    n = schedule.groupBy("video_id", "source").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("video_id"))
    return n.withColumn("percent", F.col("n") * 100.0 / total)


def schedule_gaps(schedule: DataFrame, drawn: DataFrame) -> DataFrame:
    """Per video: scheduled frames nobody drew and drawn frames nobody scheduled."""
    keys = ["video_id", "frame_idx"]
    s, d = schedule.select(*keys).distinct(), drawn.select(*keys).distinct()
    missing = s.join(d, keys, "left_anti").withColumn("side", F.lit("missing"))
    extra = d.join(s, keys, "left_anti").withColumn("side", F.lit("extra"))
    both = missing.unionByName(extra).groupBy("video_id")
    return both.agg(
        F.count_if(F.col("side") == "missing").alias("missing"),
        F.count_if(F.col("side") == "extra").alias("extra"),
    )


def best_grounding_frame(frames: DataFrame, *, method: str = "combined", min_objects: int = 3) -> DataFrame:
    """Per (video, chunk): the frame to ground on.

    ``frames``: video_id, chunk_idx, chunk_start, frame_idx, num_objects, max_iou, mean_score.
    """
    keys = ["video_id", "chunk_idx"]
    if method == "frame_zero":
        return frames.filter((F.col("frame_idx") == F.col("chunk_start")) & (F.col("num_objects") > 0))
    ranks = {
        "min_occlusion": [F.col("max_iou")],
        "best_scores": [-F.col("mean_score")],
        "combined": [F.col("max_iou") >= 0.10, -F.col("mean_score")],
    }[method]
    order = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(ranks)], F.col("frame_idx"))
    row = F.struct(*[c for c in frames.columns if c not in keys])
    # min_by combines map-side: no chunk is sorted in one task.
    best = frames.filter(F.col("num_objects") >= min_objects).groupBy(*keys).agg(
        F.min_by(row, order).alias("r")
    )
    return best.select(*keys, "r.*")


def seed_frame(frames: DataFrame, *, scan_frames: int = 125) -> DataFrame:
    """Frame with most objects among the first ``scan_frames`` frames; the earliest wins ties."""
    early = frames.filter(F.col("frame_idx") < scan_frames)
    return early.groupBy("video_id").agg(
        F.max_by("frame_idx", F.struct(F.col("num_objects"), -F.col("frame_idx"))).alias("frame_idx"),
        F.max("num_objects").alias("num_objects"),
    )


def carryover_frame(frames: DataFrame, *, min_objects: int = 3, lookback: int = 10) -> DataFrame:
    """Last of the final ``lookback`` present frames per chunk with enough objects."""
    keys = ["video_id", "chunk_idx"]
    salted = frames.withColumn("_salt", F.pmod(F.xxhash64("frame_idx"), F.lit(64)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(F.col("frame_idx").desc())
    few = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= lookback)
    w2 = Window.partitionBy(*keys).orderBy(F.col("frame_idx").desc())
    last = few.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= lookback)
    return last.filter(F.col("num_objects") >= min_objects).groupBy(*keys).agg(
        F.max("frame_idx").alias("frame_idx")
    )

"""Windows as sequences: sub-sampling, clip tiling, crop plans, scaling, assembling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.operators.distributions import quantile_row
from trackspark.functions import boxes as bx
from trackspark.functions import pooling

WINDOW = ["video_id", "bird_id", "window"]


def even_rows(tracks: DataFrame, n: int) -> DataFrame:
    """At most ``n`` evenly spaced rows of each window, by frame."""
    w = Window.partitionBy(*WINDOW)
    numbered = tracks.withColumns(
        {"_rn": F.row_number().over(w.orderBy("frame_idx")) - 1, "_n": F.count(F.lit(1)).over(w)}
    )
    picked = F.array_contains(pooling.even_positions(n, F.col("_n")), F.col("_rn").cast("long"))
    return numbered.filter(picked).drop("_rn", "_n")


def clip_plan(tracks: DataFrame, clip_frames: int, *, steps_per_clip: int | None = None) -> DataFrame:
    """Non-overlapping clips of a window's frames: frames, padding and valid model steps.

    The last clip is padded by repeating its last frame. With two frames per step
    (``steps_per_clip = clip_frames / 2``) half the valid frames, rounded up, count.
    """
    w = Window.partitionBy(*WINDOW).orderBy("frame_idx")
    clip = F.floor((F.row_number().over(w) - 1) / clip_frames).cast("int")
    out = tracks.withColumn("clip", clip).groupBy(*WINDOW, "clip").agg(
        F.min("frame_idx").alias("first_frame"),
        F.max("frame_idx").alias("last_frame"),
        F.count(F.lit(1)).alias("n_valid"),
    )
    valid = F.col("n_valid")
    if steps_per_clip and steps_per_clip * 2 == clip_frames:
        valid = F.greatest(F.floor((valid + 1) / 2), F.lit(1))
    return out.withColumns({"n_pad": F.lit(clip_frames) - F.col("n_valid"), "valid_steps": valid})


def crop_plan(
    tracks: DataFrame, *, mode: str = "union", size: int = 512, frame_w: int, frame_h: int, grid: int = 16
) -> DataFrame:
    """Crop rectangle and patch bounds of every row.

    ``plain`` centres the crop on the row's box, ``union`` on the box around all rows of its
    window; both stay inside the frame.
    """
    b = bx.box_from_array("bbox")
    rows = tracks.withColumn("_b", b)
    if mode == "plain":
        cx = F.floor((F.col("_b.x1").cast("int") + F.col("_b.x2").cast("int")) / 2)
        cy = F.floor((F.col("_b.y1").cast("int") + F.col("_b.y2").cast("int")) / 2)
    else:
        u = rows.groupBy(*WINDOW).agg(
            ((F.min("_b.x1") + F.max("_b.x2")) / 2).cast("int").alias("_cx"),
            ((F.min("_b.y1") + F.max("_b.y2")) / 2).cast("int").alias("_cy"),
        )
        rows = rows.join(u, WINDOW)
        cx, cy = F.col("_cx"), F.col("_cy")
    rows = rows.withColumns(
        {"crop_x": bx.crop_origin(cx, size, frame_w), "crop_y": bx.crop_origin(cy, size, frame_h)}
    )
    x0, x1 = bx.patch_bounds(F.col("_b.x1").cast("int"), F.col("_b.x2").cast("int"), F.col("crop_x"), size, grid)
    y0, y1 = bx.patch_bounds(F.col("_b.y1").cast("int"), F.col("_b.y2").cast("int"), F.col("crop_y"), size, grid)
    return rows.withColumns({"patch_x0": x0, "patch_x1": x1, "patch_y0": y0, "patch_y1": y1}).drop("_b", "_cx", "_cy")


def scale_columns(
    df: DataFrame, columns: Sequence[str], *, clip: float | None = None, population: bool = False
) -> DataFrame:
    """Median-impute and z-score columns over the whole table, optionally clipped.

    The mean and deviation are those of the imputed column. Medians are exact, from ranges of counted
    values.
    """
    cols = list(columns)
    med = quantile_row(df, cols, [0.5], "_med_")
    filled = df.crossJoin(F.broadcast(med)).withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")[0]) for c in cols}
    ).drop(*[f"_med_{c}" for c in cols])
    dev = F.stddev_pop if population else F.stddev_samp
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_mu_{c}"), F.greatest(dev(c), F.lit(1e-8)).alias(f"_sd_{c}")]
    stats = filled.agg(*aggs)  # one row
    out = filled.crossJoin(F.broadcast(stats))
    scaled = {}
    for c in cols:
        z = (F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}")
        scaled[c] = F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)) if clip else z
    return out.withColumns(scaled).drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


def sequence_stats(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: mean and sample deviation vectors over all steps of all sequences."""
    steps = df.select(F.explode(seq).alias("v")).select(F.posexplode("v").alias("i", "x"))
    per = steps.groupBy("i").agg(
        F.avg(F.col("x").cast("double")).alias("m"),
        F.greatest(F.stddev_samp(F.col("x").cast("double")), F.lit(1e-8)).alias("s"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", "m", "s")))
    return per.agg(ordered.alias("o")).select(
        F.transform("o", lambda e: e["m"]).alias("mean"), F.transform("o", lambda e: e["s"]).alias("std")
    )


def pooled_sequences(df: DataFrame, k: int, *, seq: str = "seq", zscore: bool = True) -> DataFrame:
    """Segment-pooled sequences, z-scored over all steps first."""
    if zscore:
        df = df.crossJoin(F.broadcast(sequence_stats(df, seq)))
        df = df.withColumn(seq, pooling.standardise(seq, F.col("mean"), F.col("std"))).drop("mean", "std")
    return df.withColumn("pooled", pooling.segment_pool(seq, k))


def join_embeddings(*sources: DataFrame, keys: Sequence[str] = tuple(WINDOW), column: str = "vec") -> DataFrame:
    """Concatenate the vectors of several keyed sources, in the order given."""
    out = sources[0].select(*keys, F.col(column).alias("_v0"))
    for i, s in enumerate(sources[1:], start=1):
        out = out.join(s.select(*keys, F.col(column).alias(f"_v{i}")), list(keys))
    return out.select(*keys, F.concat(*[F.col(f"_v{i}") for i in range(len(sources))]).alias(column))

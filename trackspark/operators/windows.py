"""Label-aligned time windows: crop labels, assign frames, drop badly covered windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.operators import blocks
from trackspark.operators.blocks import Neighbours
from trackspark.operators.joins import with_fps

ENTITY = ["video_id", "bird_id"]
WINDOW = ["video_id", "bird_id", "window"]

#: Seconds per block when labels and frames are ordered by time.
TIME_BLOCK = 3600


def align_labels(tracks: DataFrame, labels: DataFrame, fps: DataFrame) -> DataFrame:
    """Labels inside the time range each (video, bird) is tracked in."""
    ranges = with_fps(
        tracks.groupBy(*ENTITY).agg(F.min("frame_idx").alias("_a"), F.max("frame_idx").alias("_b")), fps
    ).select(
        *ENTITY, (F.col("_a") / F.col("fps")).alias("_t0"), (F.col("_b") / F.col("fps")).alias("_t1")
    )
    out = labels.join(ranges, ENTITY)
    return out.filter(F.col("time").between(F.col("_t0"), F.col("_t1"))).drop("_t0", "_t1")


def number_labels(labels: DataFrame, *, block: int = TIME_BLOCK) -> DataFrame:
    """Add ``window``: the label's position in time within (video, bird)."""
    out = blocks.row_index(labels, ENTITY, "time", "window", block=block)
    return out.withColumn("window", F.col("window").cast("int"))


def assign_windows(
    tracks: DataFrame, labels: DataFrame, fps: DataFrame, *, block: int = TIME_BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Give every frame the first label at or after it: window ``(previous label, label]``.

    Frames past the last label, and birds without labels, are dropped. Labels and frames are
    put on one time line and the next label is carried back along it, so no frame is compared
    with more than its own neighbourhood.
    """
    labels = number_labels(labels, block=block)
    t = with_fps(tracks.drop("window"), fps)
    frames = t.withColumn("_t", F.col("frame_idx") / F.col("fps")).drop("fps")
    marks = labels.select(*ENTITY, F.col("time").cast("double").alias("_t"), "window")
    line = frames.withColumn("_label", F.lit(0)).unionByName(
        marks.withColumn("_label", F.lit(1)), allowMissingColumns=True
    )
    mark = F.when(F.col("_label") == 1, F.struct(F.col("_t").alias("t"), F.col("window").alias("w")))
    carried = blocks.carry_backward(line, ENTITY, "_t", mark, "_next", tie=["_label"], block=block)
    out = carried.filter((F.col("_label") == 0) & F.col("_next").isNotNull())
    return out.withColumn("window", F.col("_next.w")).drop("_t", "_label", "_next"), labels


def label_spacing(labels: DataFrame, *, block: int = TIME_BLOCK) -> DataFrame:
    """One row: the median distance of consecutive labels over all birds (NULL without any)."""
    nb = Neighbours(labels.select(*ENTITY, "time"), ENTITY, "time", back=1, block=block)
    gaps = nb.with_columns({"gap": F.col("time") - nb.lag("time")}).filter(F.col("gap").isNotNull())
    counted = gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.expr("percentile(gap, 0.5D, n)").alias("spacing"))


def window_coverage(
    tracks: DataFrame, labels: DataFrame, fps: DataFrame, *, block: int = TIME_BLOCK
) -> DataFrame:
    """Frames per window and their share of the expected count."""
    counts = tracks.groupBy(*WINDOW).agg(F.count("frame_idx").alias("n_frames"))
    spacing = F.broadcast(label_spacing(labels, block=block))  # one row
    return (
        with_fps(counts, fps)
        .crossJoin(spacing)
        .withColumn("coverage", F.col("n_frames") / (F.col("spacing") * F.col("fps")))
        .drop("fps")
    )


def filter_incomplete(
    tracks: DataFrame,
    labels: DataFrame,
    fps: DataFrame,
    *,
    min_coverage: float = 0.5,
    max_coverage: float = 1.02,
    block: int = TIME_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Keep windows whose coverage is in range, in both tables.

    Without any two labels of one bird there is no spacing and nothing is filtered.
    """
    cov = window_coverage(tracks, labels, fps, block=block)
    spaced = F.col("spacing").isNotNull()
    in_range = F.col("coverage").between(min_coverage, max_coverage)
    keep = cov.filter(~spaced | in_range).select(*WINDOW)
    spacing = F.broadcast(label_spacing(labels, block=block))
    kept_tracks = tracks.join(keep, WINDOW, "left_semi")
    # Labels without any frame stay only when nothing is filtered at all.
    kept_labels = (
        labels.join(keep.withColumn("_k", F.lit(True)), WINDOW, "left")
        .crossJoin(spacing)
        .filter(F.col("_k") | F.col("spacing").isNull())
        .drop("_k", "spacing")
    )
    return kept_tracks, kept_labels

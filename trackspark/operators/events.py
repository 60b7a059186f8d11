"""Event periods: separation windows, occlusion periods, id transitions, overlaps, low scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import boxes as bx
from trackspark.operators import blocks
from trackspark.operators.blocks import BLOCK, Neighbours
from trackspark.session import cut_lineage


def separation_windows(
    frames: DataFrame, *, min_frames: int = 25, gap_frames: int = 5, block: int = BLOCK
) -> DataFrame:
    """Runs of frames with a positive separation score, bridging short gaps."""
    good = frames.filter(F.col("separation_score") > 0).select("video_id", "frame_idx")
    out = blocks.runs(good, ["video_id"], "frame_idx", max_step=gap_frames, block=block)
    span = F.col("run_end") - F.col("run_start") + 1
    return out.filter(span >= min_frames).select(
        "video_id",
        F.col("run_start").alias("start_frame"),
        F.col("run_end").alias("end_frame"),
        F.col("n_rows").alias("n_frames"),
    )


def _next(ends: np.ndarray, window: int) -> np.ndarray:
    """For each stretch the index of the next one that a period may start in (its count for none)."""
    return np.searchsorted(ends, ends + window, side="right")


def _exits(window: int, block: int):
    """For ``applyInPandas`` on the stretches of one block: from where the search goes on behind it.

    One row for the last stretch that surely starts a period (``at`` is null), or, without one, a row
    for each stretch that a period before the block can lead to: those in the first ``window`` rows
    and the one after.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("e")
        e, sure = pdf["e"].to_numpy(), np.flatnonzero(pdf["opens"])
        reach = _next(e, window)
        last = np.arange(len(e))
        for k in range(len(e) - 1, -1, -1):
            if reach[k] < len(e):
                last[k] = last[reach[k]]
        first = int(pdf["blk"].iloc[0]) * block
        early = int(np.searchsorted(e, first + window + 1)) + 1
        entries = pd.DataFrame({"at": e[:early], "x": e[last[:early]] + window + 1, "sure": False})
        if len(sure):
            entries["x"] = np.nan  # what leads into the block does not decide where it ends
            entries.loc[len(entries)] = [None, e[last[sure[-1]]] + window + 1, True]
        return entries.assign(video_id=pdf["video_id"].iloc[0])[["video_id", "at", "x", "sure"]].astype({"at": "Int64", "x": "Int64"})

    return run


def _entered(exits: DataFrame) -> DataFrame:
    """``video_id, at, x``: the stretches at which the search enters a block, and from where.

    Where the search leads from one block on is known if a period surely starts in the block. Blocks
    that only pass it on are jumped over by pointer doubling: after k rounds, 2**k blocks at once.
    """
    points = exits.filter("at is not null").select("video_id", F.col("at").alias("pos"), F.col("at").alias("to"), F.lit(1).alias("kind"))
    asked = exits.filter("x is not null").select("video_id", "x").distinct()
    points = points.unionByName(asked.select("video_id", F.col("x").alias("pos"), F.lit(None).cast("long").alias("to"), F.lit(0).alias("kind")))
    # A few rows a block, like every carry table.
    later = Window.partitionBy("video_id").orderBy(F.desc("pos"), F.desc("kind"))
    lands = points.withColumn("to", F.min("to").over(later.rowsBetween(Window.unboundedPreceding, 0)))
    lands = lands.filter("kind = 0 and to is not null").select("video_id", F.col("pos").alias("x"), "to")
    moves = cut_lineage(exits.join(lands, ["video_id", "x"]).select("video_id", "at", "x", "to", "sure"), "moves")
    found = moves.filter("sure").select("video_id", F.col("to").alias("at"), "x")
    jumps = moves.filter("not sure").select("video_id", "at", "x", "to")
    while not jumps.isEmpty():
        step = found.select("video_id", "at").distinct().join(jumps, ["video_id", "at"]).select("video_id", F.col("to").alias("at"), "x")
        found = cut_lineage(found.unionByName(step).distinct(), "entered")
        second = jumps.select("video_id", F.col("at").alias("to"), F.col("x").alias("x2"), F.col("to").alias("to2"))
        jumps = jumps.join(second, ["video_id", "to"]).select("video_id", "at", F.col("x2").alias("x"), F.col("to2").alias("to"))
        jumps = cut_lineage(jumps, "jumps")
    return found


def _periods(window: int):
    """For ``applyInPandas`` on the stretches of one block, with the row from where the search enters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("e")
        s, e = pdf["s"].to_numpy(), pdf["e"].to_numpy()
        reach, start = _next(e, window), s.copy()
        used = np.zeros(len(e), bool)
        open_at = np.flatnonzero(pdf["opens"]).tolist()
        if pdf["at"].notna().any():
            k = int(np.searchsorted(e, int(pdf["at"].max())))
            start[k] = max(start[k], int(pdf["x"].max()) - 1)
            open_at.insert(0, k)
        for k in open_at:
            while k < len(e) and not used[k]:
                used[k] = True
                j = reach[k]
                if j < len(e):
                    start[j] = max(start[j], e[k] + window)
                k = j
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "start_row": start[used], "end_row": e[used] + window - 1})

    return run


def occlusion_periods(
    frames: DataFrame,
    *,
    window_frames: int = 25,
    threshold: float = 0.3,
    block: int = BLOCK,
) -> DataFrame:
    """Periods where the forward sliding share of flagged rows stays at ``threshold``.

    A period ends at the last row its closing window covers, and the search resumes after it,
    so periods depend on the one before: the stretch of hot rows that is next is the first that goes
    on behind the period. A stretch after more than ``window_frames`` other rows surely starts a
    period. The rest is settled in blocks: each block is reduced to where the search leaves it for
    every way in, the ways are joined up by pointer doubling, and then each block finds its periods.
    """
    w = window_frames
    block = max(block, w + 1)
    indexed = blocks.row_index(
        frames.select("video_id", "frame_idx", "is_high_occlusion"),
        ["video_id"],
        "frame_idx",
        block=block,
    )
    nb = Neighbours(indexed, ["video_id"], "frame_idx", ahead=w, block=block)
    total, n = nb.sum_ahead("is_high_occlusion", w)
    hot = nb.with_columns({"_share": total / n}).filter(F.col("_share") >= threshold)
    stretches = blocks.runs(hot.select("video_id", "row_idx"), ["video_id"], "row_idx", block=block).select(
        "video_id", F.col("run_start").alias("s"), (F.col("run_end") + 1).alias("e")
    )
    before = Neighbours(stretches, ["video_id"], "e", back=1, block=block)
    far = before.with_columns({"_last": before.lag("e")}).withColumn("opens", F.coalesce(F.col("s") - F.col("_last") >= w, F.lit(True)))
    at = blocks.block_of("e", block).alias("blk")
    far = cut_lineage(far.select("video_id", "s", "e", "opens", at), "stretches")
    exits = far.groupBy("video_id", "blk").applyInPandas(_exits(w, block), "video_id string, at long, x long, sure boolean")
    entered = _entered(cut_lineage(exits, "exits")).select("video_id", blocks.block_of("at", block).alias("blk"), "at", "x")
    periods = (
        far.join(entered, ["video_id", "blk"], "left")
        .groupBy("video_id", "blk")
        .applyInPandas(_periods(w), "video_id string, start_row long, end_row long")
    )
    last = indexed.groupBy("video_id").agg(F.max("row_idx").alias("_last"))
    periods = periods.join(last, "video_id").withColumn("end_row", F.least("end_row", "_last"))
    at = indexed.select("video_id", "row_idx", "frame_idx")
    starts = at.select("video_id", F.col("row_idx").alias("start_row"), F.col("frame_idx").alias("start_frame"))
    ends = at.select("video_id", F.col("row_idx").alias("end_row"), F.col("frame_idx").alias("end_frame"))
    return (
        periods.join(starts, ["video_id", "start_row"])
        .join(ends, ["video_id", "end_row"])
        .select("video_id", "start_frame", "end_frame")
    )


def id_sets(tracks: DataFrame, entity: str = "tracking_id") -> DataFrame:
    return tracks.groupBy("video_id", "frame_idx").agg(
        F.sort_array(F.collect_set(entity)).alias("ids")
    )


def id_transitions(
    tracks: DataFrame, fps: DataFrame, *, entity: str = "tracking_id", block: int = BLOCK
) -> DataFrame:
    """Frames whose set of ids differs from the previous present frame."""
    nb = Neighbours(id_sets(tracks, entity), ["video_id"], "frame_idx", back=1, block=block)
    changed = nb.with_columns({"ids_before": nb.lag("ids")}).filter(
        F.col("ids_before").isNotNull() & (F.col("ids_before") != F.col("ids"))
    )
    return changed.join(fps.select("video_id", "fps"), "video_id", "left").select(
        "video_id",
        "frame_idx",
        F.round(F.col("frame_idx") / F.coalesce("fps", F.lit(25.0)), 2).alias("time"),
        "ids_before",
        F.col("ids").alias("ids_after"),
        F.array_except("ids_before", "ids").alias("lost"),
        F.array_except("ids", "ids_before").alias("gained"),
    )


def _merge_step(fps: Column, gap_seconds: float) -> Column:
    """Consecutive-frame blocks joined within the gap are one run with this step."""
    return F.greatest(F.lit(1), (fps * F.lit(float(gap_seconds))).cast("int"))


def overlap_periods(
    overlaps: DataFrame, *, merge_gap_seconds: float = 1.0, block: int = BLOCK
) -> DataFrame:
    """Periods from per-frame overlapping pairs (video_id, fps, frame_idx, id_a, id_b)."""
    keys = ["video_id", "id_a", "id_b"]
    step = _merge_step(F.col("fps"), merge_gap_seconds)
    once = overlaps.select(*keys, "fps", "frame_idx").distinct()
    out = blocks.runs(
        once, keys, "frame_idx", max_step=step, aggs=[F.max("fps").alias("fps")], block=block
    )
    return out.select(
        "video_id",
        F.array("id_a", "id_b").alias("ids"),
        F.col("run_start").alias("start"),
        F.col("run_end").alias("end"),
        F.round(F.col("run_start") / F.col("fps"), 2).alias("start_time"),
        F.round(F.col("run_end") / F.col("fps"), 2).alias("end_time"),
    )


def low_score_periods(
    tracks: DataFrame,
    fps: DataFrame,
    *,
    threshold: float = 0.8,
    min_seconds: float = 1.0,
    merge_gap_seconds: float = 1.0,
    entity: str = "tracking_id",
    block: int = BLOCK,
) -> DataFrame:
    """Per id: merged stretches of scores below ``threshold`` that last ``min_seconds``.

    Counts and minimum cover every row of the id inside the period, low or not. Rows learn
    their period from the low row before them (a carried prefix), not from a range join.
    """
    keys = ["video_id", entity]
    t = tracks.join(fps.select("video_id", "fps"), "video_id", "left").withColumn(
        "fps", F.coalesce("fps", F.lit(25.0))
    )
    low = F.col("tracker_score") < threshold
    step = _merge_step(F.col("fps"), merge_gap_seconds)
    low_rows = t.filter(low).select(*keys, "frame_idx", "fps").distinct()
    periods = blocks.runs(
        low_rows,
        keys,
        "frame_idx",
        max_step=step,
        aggs=[F.max("fps").alias("fps")],
        block=block,
    )
    lasting = F.col("run_end") - F.col("run_start") + 1 >= (
        F.col("fps") * F.lit(float(min_seconds))
    ).cast("int")
    periods = periods.filter(lasting).drop("n_rows")
    # A row belongs to the latest period that starts at or before it, if it is not past its end.
    opens = periods.select(*keys, F.col("run_start").alias("frame_idx"), F.lit(True).alias("_o"))
    marked = t.select(*keys, "frame_idx", "tracker_score").join(opens, [*keys, "frame_idx"], "left")
    value = F.when(F.col("_o"), F.col("frame_idx"))
    numbered = blocks.carry_forward(marked, keys, "frame_idx", value, "start", block=block)
    ends = periods.select(*keys, F.col("run_start").alias("start"), F.col("run_end").alias("end"))
    per = (
        numbered.filter(F.col("start").isNotNull())
        .join(ends, [*keys, "start"])
        .filter(F.col("frame_idx") <= F.col("end"))
        .groupBy(*keys, "start", "end")
        .agg(
            F.count_if(F.col("tracker_score") < threshold).alias("low_score_rows"),
            F.count(F.lit(1)).alias("total_rows"),
            F.round(F.min("tracker_score"), 3).alias("min_score"),
        )
    )
    back = periods.select(*keys, F.col("run_start").alias("start"), "fps")
    return per.join(back, [*keys, "start"]).select(
        "video_id",
        F.col(entity).alias("id"),
        "start",
        "end",
        F.round(F.col("start") / F.col("fps"), 2).alias("start_time"),
        F.round(F.col("end") / F.col("fps"), 2).alias("end_time"),
        "low_score_rows",
        "total_rows",
        "min_score",
    )


def occlusion_aware_switches(
    frames: DataFrame, *, window_size: int = 5, block: int = BLOCK
) -> DataFrame:
    """Id swaps at a stable count shortly after a high-occlusion frame.

    ``frames``: video_id, frame_idx, num_objects, objects_present, is_high_occlusion.
    """
    f = frames.select(
        "video_id",
        "frame_idx",
        "num_objects",
        F.sort_array(F.array_distinct("objects_present")).alias("ids"),
        "is_high_occlusion",
    )
    nb = Neighbours(f, ["video_id"], "frame_idx", back=window_size, block=block)
    seen = nb.with_columns(
        {
            "_ids": nb.lag("ids"),
            "_n": nb.lag("num_objects"),
            "_occ": nb.any_behind("is_high_occlusion", window_size),
        }
    )
    lost = F.sort_array(F.array_except("_ids", "ids"))
    gained = F.sort_array(F.array_except("ids", "_ids"))
    stable = (F.col("num_objects") == F.col("_n")) & (F.col("_n") > 0)
    return (
        seen.withColumns({"_lost": lost, "_gained": gained})
        .filter(stable & F.col("_occ") & (F.size("_lost") > 0) & (F.size("_lost") == F.size("_gained")))
        .select("video_id", "frame_idx", F.explode(F.arrays_zip("_lost", "_gained")).alias("z"))
        .select(
            "video_id",
            "frame_idx",
            F.col("z._lost").alias("old_id"),
            F.col("z._gained").alias("new_id"),
        )
    )


def tracking_issues(
    overlaps: DataFrame, transitions: DataFrame, low_scores: DataFrame, *, block: int = BLOCK
) -> DataFrame:
    """All events of a video in one table, ordered by start, then overlap / switch / low score.

    ``event`` numbers the events of a video in this order from 1; the table is sorted as a whole
    (by ranges, so a video with many events spreads over partitions).
    """
    ov = overlaps.withColumns({"type": F.lit("overlap"), "_rank": F.lit(0)})
    sw = transitions.select(
        "video_id",
        F.lit("id_switch").alias("type"),
        F.col("frame_idx").alias("start"),
        F.col("frame_idx").alias("end"),
        F.col("time").alias("start_time"),
        F.col("time").alias("end_time"),
        "ids_before",
        "ids_after",
        "lost",
        "gained",
        F.lit(1).alias("_rank"),
    )
    lo = low_scores.withColumns({"type": F.lit("low_score"), "_rank": F.lit(2)})
    out = ov.unionByName(sw, allowMissingColumns=True).unionByName(lo, allowMissingColumns=True)
    # Equal starts and kinds stand in the order of a hash of the whole event.
    out = out.withColumn("_tie", F.xxhash64(*out.columns))
    return _numbered(out, block).orderBy("video_id", "event")


def _numbered(events: DataFrame, block: int) -> DataFrame:
    in_order = blocks.in_blocks(events, ["video_id"], "start", block)
    here = Window.partitionBy("video_id", blocks.BLK).orderBy("start", "_rank", "_tie")
    earlier = Window.partitionBy("video_id").orderBy(blocks.BLK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = in_order.groupBy("video_id", blocks.BLK).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("video_id", blocks.BLK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = in_order.withColumn("_at", F.row_number().over(here)).join(before, ["video_id", blocks.BLK], "left")
    return out.withColumn("event", F.col("_before") + F.col("_at")).drop("_before", "_at", "_rank", "_tie", blocks.BLK)


def score_segments(
    tracks: DataFrame, *, entity: str = "tracking_id", fallback: float = 0.5, block: int = BLOCK
) -> DataFrame:
    """Contiguous presence segments with a mean score: tracker score, else score, else fallback."""
    keys = ["video_id", entity]
    cols = set(tracks.columns)
    aggs = [F.avg("tracker_score").alias("_a")]
    if "scores" in cols:
        aggs.append(F.avg("scores").alias("_b"))
    out = blocks.runs(tracks, keys, "frame_idx", aggs=aggs, block=block)
    parts = [F.col("_a")] + ([F.col("_b")] if "scores" in cols else []) + [F.lit(fallback)]
    return out.select(
        *keys,
        F.col("run_start").alias("start"),
        F.col("run_end").alias("end"),
        F.coalesce(*parts).alias("mean_score"),
    )

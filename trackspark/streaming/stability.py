"""Rolling-stability trigger with a cooldown, as a batch scan and as a stateful stream.

A frame triggers when the mean of the last ``window`` frame overlaps and its own overlap are
below the limit and ``cooldown`` frames have passed since the last trigger; the window starts
over after a trigger. Frames with fewer than two objects do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackspark.operators.blocks import ordered_fold

MAX_IOU, WINDOW, COOLDOWN = 0.08, 10, 50


def _advance(recent: list[float], since: int, value: float, *, limit: float, window: int, cooldown: int):
    recent = [*recent, value][-window:]
    since += 1
    calm = len(recent) == window and sum(recent) / window < limit
    fired = calm and since >= cooldown and value < limit
    return ([], 0, True) if fired else (recent, since, False)


def stability_triggers(
    frames: DataFrame, *, limit: float = MAX_IOU, window: int = WINDOW, cooldown: int = COOLDOWN
) -> DataFrame:
    """Trigger frames per (video, chunk): video_id, chunk_idx, frame_idx, max_iou, num_objects in."""

    def step(row: dict, state):
        recent, since = ([], cooldown) if state is None else state
        recent, since, fired = _advance(
            recent, since, row["max_iou"], limit=limit, window=window, cooldown=cooldown
        )
        out = [(row["video_id"], row["chunk_idx"], row["frame_idx"], row["max_iou"])] if fired else []
        return (recent, since), out

    rows = frames.filter(F.col("num_objects") >= 2).select(
        "video_id",
        F.col("chunk_idx").cast("int").alias("chunk_idx"),
        F.col("frame_idx").cast("int").alias("frame_idx"),
        "max_iou",
    )
    schema = "video_id string, chunk_idx int, frame_idx int, max_iou double"
    return ordered_fold(rows, ["video_id", "chunk_idx"], ["frame_idx"], step, schema)


class _Trigger(StatefulProcessor):
    """The scan's state of one chunk, which goes with the chunk's last frame or when nothing comes any more."""

    def __init__(self, limit: float, window: int, cooldown: int, idle_seconds: float):
        self.settings = {"limit": limit, "window": window, "cooldown": cooldown}
        self.idle = int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scan = handle.getValueState("scan", "recent array<double>, since int")

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent, since = [], self.settings["cooldown"]
        if self.scan.exists():
            kept = self.scan.get()
            recent, since = list(kept[0]), kept[1]
        # One chunk (at most a few thousand frames) per key and micro-batch.
        pdf = pd.concat(list(rows)).sort_values("frame_idx")
        hits, ended = [], False
        for frame, value, counts, last in zip(pdf["frame_idx"], pdf["max_iou"], pdf["counts"], pdf["last"]):
            if counts:
                recent, since, fired = _advance(recent, since, float(value), **self.settings)
                if fired:
                    hits.append((key[0], key[1], int(frame), float(value)))
            ended = ended or bool(last)
        self._forget_timers()
        if ended:
            self.scan.clear()
        else:
            self.scan.update(([float(v) for v in recent], int(since)))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(hits, columns=["video_id", "chunk_idx", "frame_idx", "max_iou"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.scan.clear()
        yield pd.DataFrame([], columns=["video_id", "chunk_idx", "frame_idx", "max_iou"])

    def close(self) -> None:
        pass


def stability_stream(
    frames: DataFrame,
    *,
    limit: float = MAX_IOU,
    window: int = WINDOW,
    cooldown: int = COOLDOWN,
    ends: Column | None = None,
    idle_seconds: float = 3600.0,
) -> DataFrame:
    """The same over a stream whose chunks arrive in frame order from batch to batch.

    ``ends`` marks the last frame of a chunk, with which its state goes. The state of a chunk without
    such a frame goes with the first batch after ``idle_seconds`` without its rows; frames that come later
    start it anew. The session needs the RocksDB state store.
    """
    some = F.col("num_objects") >= 2
    last = F.lit(False) if ends is None else F.coalesce(ends, F.lit(False))
    rows = frames.withColumns({"counts": some, "last": last}).filter(F.col("counts") | F.col("last"))
    rows = rows.select("video_id", "chunk_idx", "frame_idx", "max_iou", "counts", "last")
    return rows.groupBy("video_id", "chunk_idx").transformWithStateInPandas(
        _Trigger(limit, window, cooldown, idle_seconds),
        "video_id string, chunk_idx int, frame_idx int, max_iou double",
        "append",
        "processingTime",
    )

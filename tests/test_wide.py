"""Tile and block sizes do not change results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackspark.functions import rle
from trackspark.operators import events, frames, lifecycle, masks, tiles
from trackspark.plans import views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def det(spark):
    return views.detections(spark, SF).cache()


def rounded(df, digits=7):
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def same(a, b):
    a, b = rounded(a), rounded(b)
    a = a.select(*b.columns)
    assert b.count() > 0 and a.count() == b.count()
    assert a.exceptAll(b).count() == 0


WHOLE = 10**6


@pytest.fixture
def sizes(monkeypatch):
    """``sizes(fn)``: fn with tiles of two objects, and with whole frames in one tile."""
    real = tiles.parts_of

    def both(fn):
        out = []
        for tile in (2, WHOLE):
            monkeypatch.setattr(tiles, "parts_of", lambda df, keys, t=None, tile=tile: real(df, keys, tile))
            out.append(fn(tile))
        return out

    return both


def test_frame_metrics(det, sizes):
    same(*sizes(lambda b: frames.detection_frames(det, iou_threshold=0.07, block=max(5, b))))


def test_pairwise(det, sizes):
    s = det.select("video_id", "frame_idx", F.col("track_id").alias("bird_id"), F.col("x1").alias("centroid_x"),
                   F.when(F.col("tracker_score") < 0.99, F.col("y1")).alias("centroid_y"))
    s = s.unionByName(s.limit(3))  # equal rows stay as many as they are
    a, b = sizes(lambda _: frames.pairwise_features(s))
    same(a, b)
    assert a.count() == s.count()


def test_greedy_and_summary(det, sizes):
    t = det.withColumnRenamed("track_id", "tracking_id")
    same(*sizes(lambda b: lifecycle.greedy_matches(t, block=b + 3)))
    same(*sizes(lambda b: lifecycle.video_summary(t, block=b + 3)))
    same(lifecycle.run_metrics(lifecycle.presence(t, block=5), block=5),
         lifecycle.run_metrics(lifecycle.presence(t, block=WHOLE), block=WHOLE))


def test_masks(spark, sizes):
    m = views.masks(spark, SF).withColumn("counts", rle.rle_encode("runs")).cache()
    same(*sizes(lambda _: masks.mask_overlaps(m, entity="bird_id")))
    same(*sizes(lambda b: masks.mask_frames(m, entity="bird_id", block=b + 3)))


def test_mask_ids_may_repeat(spark):
    code = rle.encode_runs([0, 6, 94])
    m = spark.createDataFrame([("v", 1, 7, code), ("v", 1, 7, code)], "video_id string, frame_idx int, tracking_id int, counts string")
    assert [(r["id_a"], r["id_b"], r["iou"]) for r in masks.mask_overlaps(m).collect()] == [(7, 7, 1.0)]


def test_events(det):
    f = frames.detection_frames(det, iou_threshold=0.07, min_separation=0.1, block=WHOLE).cache()
    for fn in (
        lambda b: events.separation_windows(f, min_frames=3, block=b),
        lambda b: events.occlusion_periods(f, window_frames=5, threshold=0.6, block=b),
        lambda b: events.occlusion_aware_switches(f, block=b),
    ):
        same(fn(4), fn(WHOLE))
    fps = views.videos(det.sparkSession, SF)
    t = det.withColumnRenamed("track_id", "tracking_id")
    low = lambda b: events.low_score_periods(t, fps, threshold=0.8, min_seconds=0.1, merge_gap_seconds=0.2, block=b)
    same(low(4), low(WHOLE))
    same(events.id_transitions(t, fps, block=4), events.id_transitions(t, fps, block=WHOLE))


def test_occlusion_scan_against_loop(spark):
    rng = np.random.default_rng(3)
    rows = []
    for v in range(4):
        at, flag = 0, False
        for _ in range(400):
            at += int(rng.integers(1, 3))
            flag = (not flag) if rng.random() < 0.12 else flag
            rows.append((f"v{v}", at, bool(flag)))
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, is_high_occlusion boolean")
    want = set()
    for v, g in pd.DataFrame(rows, columns=["v", "f", "o"]).groupby("v"):
        f, o = g["f"].to_numpy(), g["o"].to_numpy()
        hot = [o[i : i + 9].mean() >= 0.5 for i in range(len(f))]
        i = 0
        while i < len(f):
            if not hot[i]:
                i += 1
                continue
            j = next((k for k in range(i, len(f)) if not hot[k]), len(f))
            want.add((v, int(f[i]), int(f[min(j + 8, len(f) - 1)])))
            i = j + 9
    for block in (13, WHOLE):
        got = events.occlusion_periods(df, window_frames=9, threshold=0.5, block=block)
        assert {tuple(r) for r in got.collect()} == want and len(want) > 10


@pytest.mark.parametrize("block", [10, 64, WHOLE])
def test_occlusion_on_one_single_chain(spark, block):
    """Hot and cold rows in turn: every period hangs on the one before, over all blocks."""
    n, w = 3000, 9
    flags = [k % 4 < 2 or k % 7 == 0 for k in range(n)]
    rows = [("a", 2 * k, f) for k, f in enumerate(flags)] + [("b", k, True) for k in range(200)] + [("c", 5, True), ("c", 6, False), ("d", 1, False)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, is_high_occlusion boolean")
    want = set()
    for v in "abcd":
        f, o = zip(*[(f, o) for x, f, o in rows if x == v])
        hot = [np.mean(o[i : i + w]) >= 0.6 for i in range(len(f))]
        i = 0
        while i < len(f):
            if not hot[i]:
                i += 1
                continue
            j = next((k for k in range(i, len(f)) if not hot[k]), len(f))
            want.add((v, f[i], f[min(j + w - 1, len(f) - 1)]))
            i = j + w
    got = events.occlusion_periods(df, window_frames=w, threshold=0.6, block=block)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100

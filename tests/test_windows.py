import pytest

from trackspark.operators import windows

TRACK = "video_id string, bird_id int, frame_idx int"
LABEL = "video_id string, bird_id int, time double"


@pytest.fixture(scope="module")
def fps(spark):
    return spark.createDataFrame([("v1", 25.0)], "video_id string, fps double")


def frames(spark, bird, lo, hi):
    return spark.createDataFrame([("v1", bird, f) for f in range(lo, hi)], TRACK)


def times(spark, *rows):
    return spark.createDataFrame([("v1", b, float(t)) for b, t in rows], LABEL)


def test_align(spark, fps):
    t = frames(spark, 1, 125, 250).union(frames(spark, 2, 0, 250))
    l = times(spark, *[(b, x) for b in (1, 2, 99) for x in (0, 5, 10, 15)])
    got = {}
    for r in windows.align_labels(t, l, fps).collect():
        got.setdefault(r["bird_id"], set()).add(r["time"])
    assert got == {1: {5.0}, 2: {0.0, 5.0}}


@pytest.mark.parametrize("block", [1, 7, 3600])
def test_label_edges(spark, fps, block):
    t, l = windows.assign_windows(frames(spark, 1, 0, 250), times(spark, (1, 5), (1, 10)), fps, block=block)
    n = {}
    for r in t.collect():
        n.setdefault(r["window"], []).append(r["frame_idx"])
    assert (min(n[0]), max(n[0]), min(n[1]), max(n[1])) == (0, 125, 126, 249)
    assert sorted(r["window"] for r in l.collect()) == [0, 1]


@pytest.mark.parametrize("block", [2, 3600])
def test_frames_past_the_last_label_go(spark, fps, block):
    t = frames(spark, 1, 0, 400).union(frames(spark, 5, 0, 10))
    t, _ = windows.assign_windows(t, times(spark, (1, 5), (1, 10)), fps, block=block)
    assert t.count() == 251


def coverage(spark, fps, counts, spacing=5):
    rows = [("v1", 1, w * 1000 + i, w) for w, n in enumerate(counts) for i in range(n)]
    t = spark.createDataFrame(rows, TRACK + ", window int")
    l = spark.createDataFrame([("v1", 1, float(spacing * (w + 1)), w) for w in range(len(counts))], LABEL + ", window int")
    return windows.filter_incomplete(t, l, fps)


def test_coverage_filter(spark, fps):
    t, l = coverage(spark, fps, [10, 80, 125, 200, 63])
    assert sorted(r["window"] for r in l.collect()) == [1, 2, 4]
    assert t.count() == 80 + 125 + 63


def test_single_labels_are_kept(spark, fps):
    t, l = coverage(spark, fps, [5])
    assert t.count() == 5 and l.count() == 1

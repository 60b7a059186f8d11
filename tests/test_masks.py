import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackspark.functions import rle
from trackspark.operators import features, masks

H, W = 100, 100


def runs_of(bitmap):
    """Run lengths of an (H, W) bitmap, column by column."""
    flat = bitmap.T.ravel().astype(int)
    cuts = np.flatnonzero(np.diff(flat)) + 1
    lengths = np.diff(np.concatenate(([0], cuts, [len(flat)])))
    return ([0] if flat[0] else []) + lengths.tolist()


def blob(rng, h=24, w=30, share=0.5):
    b = rng.random((h, w)) < share
    return b | np.roll(b, 1, 0) & np.roll(b, 1, 1)


def test_code_round_trip():
    rng = np.random.default_rng(0)
    for i in range(300):
        runs = rng.integers(i % 2, 5000, rng.integers(1, 60))
        assert (rle.decode_runs(rle.encode_runs(runs)) == runs).all()


def measured(bitmaps):
    """The measures of a batch, one dict a mask; an empty dict for a mask without pixels or none at all."""
    codes = pa.array([None if b is None else rle.encode_runs(runs_of(b)) for b in bitmaps], pa.string())
    found = rle.shapes(codes, np.array([1 if b is None else b.shape[0] for b in bitmaps], np.int64))
    out = [{} for _ in bitmaps]
    for k, row in enumerate(found["mask"].tolist()):
        out[row] = {name: v[k] for name, v in found.items()}
    return out


def some_bitmaps(n, seed=1):
    rng = np.random.default_rng(seed)
    out = [blob(rng, int(rng.integers(2, 30)), int(rng.integers(2, 40)), rng.uniform(0.05, 0.8)) for _ in range(n)]
    corner = np.ones((9, 12), bool)
    corner[2:, 5:] = False  # an L
    apart = np.zeros((9, 12), bool)
    apart[:, 1:3] = apart[4:7, 8:] = True
    return out + [corner, apart, corner[::-1], np.ones((4, 7), bool), None, np.zeros((5, 5), bool), corner.T]


def test_batches_decode_like_single_masks():
    bitmaps = some_bitmaps(40)
    codes = [None if b is None else rle.encode_runs(runs_of(b)) for b in bitmaps]
    for part in (codes, codes[3:9], [None], [], ["", None]):
        runs, owner = rle.decode_batch(pa.array(part, pa.string()))
        for k, code in enumerate(part):
            assert runs[owner == k].tolist() == ([] if not code else rle.decode_runs(code).tolist())
    sliced = pa.array(codes, pa.string()).slice(5, 7)
    assert rle.decode_batch(sliced)[0].tolist() == rle.decode_batch(pa.array(codes[5:12], pa.string()))[0].tolist()


def test_geometry_against_pixels():
    bitmaps = some_bitmaps(60)
    for b, g in zip(bitmaps, measured(bitmaps), strict=True):
        if b is None or not b.any():
            assert g == {}
            continue
        ys, xs = np.nonzero(b)
        assert g["mask_area"] == len(xs)
        cov = np.cov(np.vstack([xs, ys]), bias=True)
        lam = np.linalg.eigvalsh(cov)
        assert np.allclose([g["centroid_x"], g["centroid_y"]], [xs.mean(), ys.mean()])
        if lam[0] > 1e-9:
            assert np.isclose(g["elongation"], np.sqrt(lam[1] / lam[0])) and np.isclose(g["eccentricity"], np.sqrt(1 - lam[0] / lam[1]))
        if abs(cov[0, 1]) > 1e-9:  # with its sign
            assert np.isclose(g["orientation"], 0.5 * np.arctan2(2 * cov[0, 1], cov[0, 0] - cov[1, 1]))
        assert g["box"].tolist() == [xs.min(), ys.min(), xs.max(), ys.max()]
        hull = hull_by_turns(list(zip(xs.tolist(), ys.tolist()))) if len(xs) > 2 else 0.0
        assert np.isclose(g["solidity"], len(xs) / hull) if hull > 1e-9 else np.isnan(g["solidity"])


def hull_by_turns(points):
    """Monotone chain over all pixels, then the shoelace formula."""
    pts = sorted(points)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(half(pts) + half(pts[::-1]), float)
    a, b = ring.T
    return abs((a * np.roll(b, -1) - np.roll(a, -1) * b).sum()) / 2


def test_single_pixel():
    one = np.zeros((H, W), bool)
    one[3, 4] = True
    (got,) = measured([one])
    assert (got["mask_area"], got["centroid_x"], got["centroid_y"]) == (1.0, 4.0, 3.0)
    assert np.isnan(got["elongation"]) and np.isnan(got["solidity"])


def test_known_string_and_missing_mask(spark):
    """A string written out by hand: runs 6 1 40 4 5 4 5 4 21 and, as differences, 6 1 40 3 -35 0 0 0 16."""
    assert rle.decode_runs("61X13mN000`0").tolist() == [6, 1, 40, 4, 5, 4, 5, 4, 21]
    assert rle.encode_runs([6, 1, 40, 4, 5, 4, 5, 4, 21]) == "61X13mN000`0"
    df = spark.createDataFrame([(None, 10), (rle.encode_runs([100]), 10)], "counts string, h int")
    out = df.select(
        rle.mask_area("counts").alias("a"),
        rle.mask_box("counts", "h").alias("b"),
        rle.mask_geometry("counts", "h").alias("g"),
        rle.body_thirds("counts", "h").alias("t"),
        rle.spread_points(2)("counts", "h").alias("p"),
        rle.rle_decode("counts").alias("r"),
    ).collect()
    assert out[0]["a"] is None and out[0]["b"] is None and out[0]["g"]["mask_area"] is None and out[0]["p"] is None and out[0]["r"] is None
    assert out[1]["a"] == 0 and out[1]["g"]["mask_area"] == 0.0 and out[1]["r"] == [100]


def test_sweep_against_pixels():
    """All pairs of all frames of a batch at once: masks with parts, without pixels, over the whole picture."""
    rng = np.random.default_rng(3)
    bitmaps, frame = [], []
    for f in range(12):
        for _ in range(int(rng.integers(0, 7))):
            kind = rng.integers(0, 5)
            b = {0: np.zeros((24, 30), bool), 1: np.ones((24, 30), bool)}.get(int(kind), blob(rng, share=rng.uniform(0.02, 0.6)))
            bitmaps.append(b)
            frame.append(f)
    codes = pa.array([rle.encode_runs(runs_of(b)) for b in bitmaps])
    got = rle.overlaps(*rle.intervals(*rle.decode_batch(codes)), np.array(frame))
    want = {}
    for i in range(len(bitmaps)):
        for j in range(i + 1, len(bitmaps)):
            n = int((bitmaps[i] & bitmaps[j]).sum())
            if frame[i] == frame[j] and n:
                want[i, j] = n
    assert dict(zip(zip(got["a"].tolist(), got["b"].tolist()), got["n"].tolist())) == want and len(want) > 30


def test_spread_points_and_thirds(spark):
    rng = np.random.default_rng(4)
    data, want, thirds = [], [], []
    for i in range(20):
        b = blob(rng)
        xs, ys = np.nonzero(b.T)
        at = np.linspace(0, len(xs) - 1, 4, dtype=int)
        want.append([[int(xs[k]), int(ys[k])] for k in at])
        data.append((i, rle.encode_runs(runs_of(b)), [b.shape[0], b.shape[1]]))
        thirds.append(int(b.sum()))
    df = spark.createDataFrame(data, "i int, counts string, size array<int>")
    got = df.select("i", rle.spread_points(4)("counts", masks.height()).alias("p"), rle.body_thirds("counts", masks.height()).alias("t"),
                    rle.random_points(5)("counts", masks.height(), F.col("i")).alias("r")).orderBy("i").collect()
    assert [r["p"] for r in got] == want
    assert [sum(r["t"]) for r in got] == thirds
    assert all(len({tuple(p) for p in r["r"]}) == 5 for r in got)


@pytest.fixture(scope="module")
def squares(spark):
    rows = []
    for v in ("v1", "v2"):
        for f in range(50):
            for bird, (x, y) in ((1, (10, 10 + f)), (2, (50, 50))):
                b = np.zeros((H, W), bool)
                b[y : y + 10, x : x + 10] = True
                rows.append((v, bird, f, [float(x), float(y), x + 10.0, y + 10.0], rle.encode_runs(runs_of(b)), [H, W], f // 10))
    return spark.createDataFrame(rows, "video_id string, bird_id int, frame_idx int, bbox array<double>, counts string, size array<int>, window int")


def test_square_tracks(squares):
    f = features.frame_features(masks.spatial_features(squares)).cache()
    assert f.filter(F.col("velocity").isNull()).count() == 4  # first frame of each bird and video
    v = {r["bird_id"]: (r["lo"], r["hi"]) for r in f.groupBy("bird_id").agg(F.min("velocity").alias("lo"), F.max("velocity").alias("hi")).collect()}
    assert v == {1: (1.0, 1.0), 2: (0.0, 0.0)}
    first = f.filter("frame_idx = 0 and bird_id = 1 and video_id = 'v1'").first()
    assert np.isclose(first["min_dist_to_other"], np.hypot(40, 40)) and first["nearest_neighbor_id"] == 2
    assert first["mask_area"] == 100 and np.isclose(first["solidity"], 100 / 81)
    s = features.summarise(f)
    assert s.count() == 20 and {r["n_frames"] for r in s.collect()} == {10}
    assert len(s.columns) == 3 + 17 * 9 + 1
    seq = features.window_sequences(f).collect()
    assert all(len(r["seq"]) == 10 and len(r["seq"][0]) == 17 for r in seq)


def test_summary_statistics_against_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"video_id": "v", "bird_id": 1, "window": np.repeat(np.arange(6), [1, 2, 3, 4, 40, 41]), "mask_area": rng.normal(5, 2, 91)})
    pdf.loc[50, "mask_area"] = np.nan
    pdf.loc[pdf["window"] == 3, "mask_area"] = 7.0
    got = features.summarise(spark.createDataFrame(pdf), names=["mask_area"]).toPandas().set_index("window").sort_index()
    g = pdf.groupby("window")["mask_area"]
    want = {
        "mean": g.mean(), "std": g.std(), "median": g.median(), "skew": g.skew(), "kurt": g.apply(pd.Series.kurt),
        "mad": g.apply(lambda x: (x - x.median()).abs().median()), "cv": g.std() / g.mean(), "q10": g.quantile(0.1), "q90": g.quantile(0.9),
    }
    for k, w in want.items():
        assert np.allclose(got[f"mask_area_{k}"].astype(float), w.astype(float), equal_nan=True), k


def test_chunk_id_matching(spark):
    pairs = spark.createDataFrame(
        [("v", 1, 0, 5, 0.9), ("v", 1, 1, 5, 0.8), ("v", 1, 1, 0, 0.3), ("v", 1, 2, 6, 0.05), ("v", 2, 0, 3, 0.5), ("v", 2, 3, 3, 0.4)],
        "video_id string, chunk_idx int, new_id int, prev_id int, iou double",
    )
    ids = spark.createDataFrame([("v", 1, i) for i in (0, 1, 2)] + [("v", 2, i) for i in (0, 3)], "video_id string, chunk_idx int, new_id int")
    got = {(r["chunk_idx"], r["new_id"]): r["mapped_id"] for r in masks.match_ids_across_chunks(pairs, ids).collect()}
    # Chunk 2: id 3 lost its value to id 0, so it takes a fresh one.
    assert got == {(1, 0): 5, (1, 1): 0, (1, 2): 2, (2, 0): 3, (2, 3): 4}


def plain_thirds(b):
    """Every pixel of a bitmap laid on the major axis, as the mask-by-mask form did."""
    x, y = np.nonzero(b.T)
    if len(x) < 10:
        return None
    m = np.stack([x, y]).astype(float)
    _, v = np.linalg.eigh(np.cov(m, bias=True))
    axis = v[:, 1] if v[np.abs(v[:, 1]).argmax(), 1] > 0 else -v[:, 1]
    along = axis @ m
    lo, extent = along.min(), np.ptp(along)
    return np.bincount((along >= lo + extent / 3).astype(int) + (along >= lo + 2 * extent / 3), minlength=3).tolist()


def test_thirds_and_points_of_a_batch_against_pixels():
    bitmaps = some_bitmaps(200)
    codes = pa.array([None if b is None else rle.encode_runs(runs_of(b)) for b in bitmaps], pa.string())
    heights = np.array([1 if b is None else b.shape[0] for b in bitmaps], np.int64)
    found = dict(zip(*(v.tolist() for v in rle.thirds(codes, heights))))
    want = [None if b is None else plain_thirds(b) for b in bitmaps]
    # A pixel right on a cut may fall on either side of it.
    off = [k for k, w in enumerate(want) if w is not None and np.abs(np.subtract(found[k], w)).max() > 1]
    assert set(found) == {k for k, w in enumerate(want) if w is not None} and not off
    points = rle.pixels_at(codes, heights, 4)
    for k, b in enumerate(bitmaps):
        at = np.stack(np.nonzero(b.T), 1) if b is not None else []
        assert points[k].tolist() == ([at[i * (len(at) - 1) // 3].tolist() for i in range(4)] if len(at) else [[0, 0]] * 4)


def test_batches_encode_like_single_masks():
    rng = np.random.default_rng(5)
    runs = [None, [], [0], [0, 2**31 - 1, 5, 1, 2**31 - 1, 0]] + [rng.integers(0, 5000, n).tolist() for n in range(60)]
    column = pa.array(runs, pa.list_(pa.int32()))
    want = [None if r is None else rle.encode_runs(r) for r in runs]
    assert rle.encode_batch(column).to_pylist() == want
    assert rle.encode_batch(column.slice(3, 9)).to_pylist() == want[3:12]
    assert rle.encode_batch(column.slice(0, 0)).to_pylist() == []


def test_a_batch_is_coded_at_once():
    """Was mask by mask: 20,000 masks of 80 runs took 10 s and more."""
    import time

    column = pa.array([[4800, *([50, 430] * 39), 50]] * 20_000, pa.list_(pa.int32()))
    start = time.process_time()
    codes = rle.encode_batch(column)
    rle.thirds(codes, np.full(len(codes), 480))
    rle.pixels_at(codes, np.full(len(codes), 480), 3)
    assert time.process_time() - start < 5


def test_ranges_and_rectangles_of_a_batch_like_single_masks():
    rng = np.random.default_rng(8)
    runs = [rng.integers(0, [2, 50, 5000][k % 3], rng.integers(0, 30)).tolist() for k in range(300)]
    codes = pa.array([None if k % 11 == 0 else rle.encode_runs(r) for k, r in enumerate(runs)], pa.string())
    want = rle.intervals(*rle.decode_batch(codes))
    assert all(a.tolist() == b.tolist() for a, b in zip(rle.ranges(codes), want))
    x, y, w, h = (rng.integers(lo, hi, 400) for lo, hi in ((0, 600), (0, 430), (1, 40), (1, 50)))
    boxes = [[a * 480 + b, *[d, 480 - d] * (c - 1), d, 640 * 480 - (a + c - 1) * 480 - b - d] for a, b, c, d in zip(*(v.tolist() for v in (x, y, w, h)))]
    assert rle.encode_rectangles(x, y, w, h, 480, 640).to_pylist() == [rle.encode_runs(b) for b in boxes]


@pytest.fixture(scope="module")
def crowd(spark):
    """Frames of rectangles, a missing mask, an empty one, and rows without a frame or a video."""
    rng = np.random.default_rng(12)
    x, y, w, h = (rng.integers(lo, hi, 90) for lo, hi in ((0, 70), (0, 70), (5, 30), (5, 30)))
    codes = rle.encode_rectangles(x, y, w, h, H, W).to_pylist()
    rows = [("v", k // 6, k % 6, c) for k, c in enumerate(codes)] + [("v", 20, 1, None), ("v", 20, 2, rle.encode_runs([H * W])), ("v", 20, 3, codes[0])]
    rows += [("v", None, 1, codes[1]), ("v", None, 2, codes[1]), (None, 3, 4, codes[2])]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, tracking_id int, counts string").withColumn("size", F.array(F.lit(H), F.lit(W)))
    return df, (x, y, w, h)


def test_masks_of_a_frame_are_decoded_once(crowd):
    """Geometry and overlaps decoded every mask anew, and pairs went back to Spark as arrays."""
    plan = masks.mask_frames(crowd[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "mask_pairs" not in plan and "mask_geometry" not in plan


def test_mask_frames_with_missing_parts(crowd):
    got = {(r["video_id"], r["frame_idx"]): r for r in masks.mask_frames(crowd[0]).collect()}
    assert len(got) == 15 + 3
    odd = got["v", 20]
    assert odd["num_objects"] == 3 and odd["objects_present"] == [1, 2, 3] and odd["mean_centroid_distance"] == float("inf")
    assert (odd["min_mask_area"], odd["num_overlapping_pairs"], odd["mean_pairwise_mask_iou"]) == (0, 0, 0)
    assert got["v", None]["num_objects"] == 2 and got["v", None]["min_centroid_distance"] is None and got["v", None]["mask_area_variance"] == 0
    assert got[None, 3]["objects_present"] == [4] and got[None, 3]["is_high_occlusion"] is None


def test_distances_of_masks_are_added_by_object(crowd):
    """Were added in one run over all pairs, which lost more bits than the SQL twin does."""
    df, (x, y, w, h) = crowd
    got = {r["frame_idx"]: r["mean_centroid_distance"] for r in masks.mask_frames(df.filter("frame_idx < 15 and video_id is not null")).collect()}
    cx, cy = (x + (w - 1) / 2).tolist(), (y + (h - 1) / 2).tolist()
    apart = 0
    for f in range(15):
        total = plain = 0.0
        for a in range(4, -1, -1):
            of_one = 0.0
            for b in range(a + 1, 6):
                of_one += np.sqrt((cx[6 * f + a] - cx[6 * f + b]) ** 2 + (cy[6 * f + a] - cy[6 * f + b]) ** 2)
            total += of_one
        for a in range(5):
            for b in range(a + 1, 6):
                plain += np.sqrt((cx[6 * f + a] - cx[6 * f + b]) ** 2 + (cy[6 * f + a] - cy[6 * f + b]) ** 2)
        assert got[f] == total / 15
        apart += got[f] != plain / 15
    assert apart > 0

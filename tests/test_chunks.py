import numpy as np

from trackspark.operators import chunks

# Published schedule inputs of five recordings (fps, frames, cuts, periods) and
# the number of keyframes per source they lead to.
SCHEDULES = [
    ("C1G2_day_29", 24.999382861507055, 22515, "1579,3027,4676,5973,7475,8841,10318,12082,13739,15136,16456,17753,19592,21111", "21477-21820;7127-7433;6876-7126", (42, 15, 31)),
    ("C2G2_day_28", 25.001957237939898, 22524, "1534,3040,4671,6135,7401,8956,10487,11832,13314,14771,16322,17883,19498,20910", "14910-15145;6848-7075;2296-2515", (42, 15, 31)),
    ("C3G2_day_29", 25.000827194714063, 22500, "1271,2996,4307,5858,7324,9247,10696,12194,13616,15249,16285,18248,19387,20863", "19043-19328;3250-3519;8948-9173", (42, 15, 30)),
    ("C4G2_day_29", 24.999698983115618, 22515, "1424,3020,4573,5834,7563,8839,10296,11890,13552,15000,16605,18168,19316,20777", "7254-7557;17318-17511;20921-21078", (42, 15, 30)),
    ("C5G3_day_28", 24.998628832013505, 22510, "1728,3091,4271,6100,7259,8985,10714,12151,13284,15236,16573,18077,19328,21076", "15563-15989;17069-17341;12665-12881", (42, 15, 31)),
]


def test_published_keyframes(spark):
    v = spark.createDataFrame([(s[0], s[1], s[2]) for s in SCHEDULES], "video_id string, fps double, total_frames int")
    cuts = [(s[0], i + 1, int(b)) for s in SCHEDULES for i, b in enumerate(s[3].split(","))]
    c = spark.createDataFrame(cuts, "video_id string, chunk_idx int, start long")
    periods = [(s[0], *map(int, p.split("-"))) for s in SCHEDULES for p in s[4].split(";")]
    p = spark.createDataFrame(periods, "video_id string, start_frame int, end_frame int")
    out = chunks.keyframe_schedule(c, p, v)
    assert out.count() == 438
    got = {(r["video_id"], r["source"]): r["n"] for r in chunks.schedule_summary(out).collect()}
    for s in SCHEDULES:
        assert tuple(got[s[0], k] for k in ("chunk_guided", "occlusion_bracketing", "uniform")) == s[5]


def videos(spark, *rows):
    return spark.createDataFrame(list(rows), "video_id string, fps double, total_frames int")


def spans(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["video_id"], r["chunk_idx"])):
        out.setdefault(r["video_id"], []).append((r["start"], r["end"], r["model_type"]))
    return out


def test_fixed_chunks(spark):
    v = videos(spark, ("a", 25.0, 4500), ("b", 25.0, 4600), ("c", 25.0, 1600), ("d", 25.0, 700), ("e", 25.0, 3200))
    got = spans(chunks.fixed_chunks(v, chunk_seconds=60))
    t = "tracker"
    assert got["a"] == [(0, 1500, "video"), (1500, 3000, t), (3000, 4500, t)]
    assert got["b"] == [(0, 1500, "video"), (1500, 3000, t), (3000, 4600, t)]
    assert got["c"] == [(0, 1500, "video"), (1500, 1600, t)]  # chunk 0 absorbs nothing
    assert got["d"] == [(0, 700, "video")]
    assert got["e"] == [(0, 1500, "video"), (1500, 3000, t), (3000, 3200, t)]


def brute(total, fps, m, chunk, search, longest):
    c, r, top = int(fps * chunk), int(fps * search), int(fps * longest)
    cuts, s = [0], min(c, total)
    while s < total:
        cuts.append(s)
        e = min(s + c, total)
        s = total if 0 < total - e < 0.1 * c else e
    at = list(cuts)
    for i in range(1, len(cuts)):
        nxt = at[i + 1] if i + 1 < len(at) else total
        ok = [f for f in sorted(m) if abs(f - cuts[i]) <= r and 0 <= f <= total and f - at[i - 1] <= top and nxt - f <= top]
        sep = [f for f in ok if m[f][0] > 0]
        best = min(sep, key=lambda f: (-m[f][0], f)) if sep else None
        if best is None or best == cuts[i]:
            fb = [f for f in ok if m[f][1] >= 2]
            best = min(fb, key=lambda f: (m[f][2], -(0 if np.isinf(m[f][3]) else m[f][3]), f)) if fb else None
        at[i] = cuts[i] if best is None else best
    ends = at[1:] + [total]
    if len(at) > 1 and total - at[-1] < 0.1 * c:
        at, ends = at[:-1], ends[:-2] + [total]
    return [(a, e, "video" if i == 0 else "tracker") for i, (a, e) in enumerate(zip(at, ends))]


def test_adaptive_chunks_against_loop(spark):
    rng = np.random.default_rng(7)
    rows, vids, want = [], [], {}
    for k in range(12):
        total, v = int(rng.integers(300, 1200)), f"v{k:02d}"
        m = {}
        for f in range(total):
            if rng.random() < 0.15:
                continue
            n = int(rng.integers(1, 5))
            sep = float(rng.integers(1, 9)) / 10 if rng.random() < (0.0 if k % 3 == 0 else 0.2) else 0.0
            m[f] = (sep, n, float(rng.integers(0, 6)) / 10, float("inf") if n < 2 else float(rng.integers(1, 9)) / 10)
            rows.append((v, f, *m[f]))
        vids.append((v, 25.0, total))
        want[v] = brute(total, 25.0, m, 4, 1.5, 5.0)
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, separation_score double, num_objects int, max_pairwise_bbox_iou double, min_centroid_distance double")
    got = spans(chunks.adaptive_chunks(df, videos(spark, *vids), chunk_seconds=4, search_seconds=1.5, max_seconds=5.0))
    assert got == want


def test_choice_clip_and_carryover(spark):
    a = spark.createDataFrame([("v1", 0, 0, 50, "video"), ("v1", 1, 50, 90, "tracker")], "video_id string, chunk_idx int, start long, end long, model_type string")
    b = spark.createDataFrame([("v1", 0, 0, 90, "video"), ("v2", 0, 0, 90, "video")], a.schema)
    out = chunks.choose_chunks(a, b)
    assert out.count() == 3
    assert spans(chunks.clip_chunks(out, videos(spark, ("v1", 25.0, 40), ("v2", 25.0, 60)))) == {"v1": [(0, 40, "video")], "v2": [(0, 60, "video")]}
    assert chunks.boundaries(a).first()["prev_chunk_end"] == 49
    m = spark.createDataFrame([("v2", [[0, 10], [10, 30]], [0])], "video_id string, ranges array<array<int>>, tracker_idx array<int>")
    assert spans(chunks.manual_chunks(m))["v2"] == [(0, 10, "tracker"), (10, 30, "tracker")]
    f = spark.createDataFrame([("v", 0, i, 3 if i == 20 else 1) for i in range(30)], "video_id string, chunk_idx int, frame_idx int, num_objects int")
    assert chunks.carryover_frame(f).first()["frame_idx"] == 20
    assert chunks.carryover_frame(f, lookback=5).count() == 0
    p = spark.createDataFrame([("v", 0, 5.0, 50.0), ("v", 0, 300.0, 200.0)], "video_id string, chunk_idx int, x double, y double")
    assert chunks.border_points(p, 640, 480, margin=10).first()["border_share"] == 0.5

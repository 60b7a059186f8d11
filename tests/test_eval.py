import itertools

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.functions.assign import best_pairs
from trackspark.operators import moteval as M

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def best_total(pairs, most):
    """Most matches and best score (or best score alone) over all matchings."""
    lefts = sorted({p[0] for p in pairs})

    def rest(i, used):
        if i == len(lefts):
            return (0, 0.0)
        best = rest(i + 1, used)
        for a, b, score in pairs:
            if a == lefts[i] and b not in used:
                n, s = rest(i + 1, used | {b})
                best = max(best, (n + 1, s + score), key=lambda x: x if most else x[1])
        return best

    return rest(0, frozenset())


@pytest.mark.parametrize("most", [True, False])
def test_best_pairs_against_all_matchings(most):
    rng = np.random.default_rng(0)
    for _ in range(400):
        n, m = rng.integers(1, 6, 2)
        pairs = [(a, b, float(rng.integers(1, 5) if rng.random() < 0.5 else rng.random())) for a in range(n) for b in range(m) if rng.random() < 0.6]
        chosen = [pairs[k] for k in best_pairs(pairs, most=most)]
        assert len({a for a, _, _ in chosen}) == len(chosen) == len({b for _, b, _ in chosen})
        count, total = best_total(pairs, most)
        assert np.isclose(sum(s for _, _, s in chosen), total) and (not most or len(chosen) == count)


def test_long_augmenting_path():
    n = 3000
    pairs = [(i, i, 1.0) for i in range(n)] + [(i, i + 1, 2.0) for i in range(n - 1)] + [(n, 0, 1.0), (n, n, 1.0)]
    assert sum(pairs[k][2] for k in best_pairs(pairs, most=False)) == 2 * (n - 1) + 1


def test_best_pairs_prefers_more_matches():
    pairs = [(0, 0, 0.9), (0, 1, 0.5), (1, 0, 0.5)]
    assert sorted(best_pairs(pairs, most=True)) == [1, 2]
    assert best_pairs([(0, 0, 9.0), (0, 1, 1.0), (1, 0, 1.0)], most=False) == [0]


@pytest.fixture(scope="module")
def scene(spark):
    """Two objects over ten frames; the tracker swaps their ids at frame 5, misses one box at
    frame 2 and draws an extra one at frame 3. Variant 'none' predicts nothing."""
    truth, pred = [], []
    for f in range(10):
        for i in (1, 2):
            b = (100.0 * i, 0.0, 100.0 * i + 50, 50.0)
            truth.append(("C1G1D28", f, i, b))
            if (f, i) != (2, 1):
                pred.append(("swap", "C1G1D28", f, i if f < 5 else 3 - i, b))
    pred.append(("swap", "C1G1D28", 3, 9, (400.0, 0.0, 450.0, 50.0)))
    pred.append(("swap", "C1G1D28", 99, 1, (0.0, 0.0, 9.0, 9.0)))  # no truth there: not scored
    t = spark.createDataFrame(truth, f"video_id string, frame_idx int, id long, box {BOX}")
    p = spark.createDataFrame(pred, f"variant string, video_id string, frame_idx int, id long, box {BOX}")
    v = spark.createDataFrame([("swap",), ("none",)], "variant string")
    return t, p, v


def test_clear_and_identity(scene):
    t, p, v = scene
    out = M.mot_scores(M.clear_counts(M.clear_events(t, p, v)), M.identity_counts(t, p, v))
    r = {x["variant"]: x.asDict() for x in out.collect()}
    s = r["swap"]
    assert (s["num_objects"], s["num_misses"], s["num_false_positives"], s["num_switches"]) == (20, 1, 1, 2)
    assert (s["num_frames"], s["num_unique_objects"], s["num_fragmentations"]) == (10, 2, 1)
    assert (s["mostly_tracked"], s["partially_tracked"], s["mostly_lost"]) == (2, 0, 0)
    assert np.isclose(s["mota"], 1 - 4 / 20) and np.isclose(s["recall"], 19 / 20) and np.isclose(s["precision"], 19 / 20)
    assert np.isclose(s["motp"], 0)
    # Best fixed identities explain frames 0-4 or 5-9: ten of the nineteen matched boxes.
    assert np.isclose(s["idf1"], 2 * 10 / (20 + 20)) and np.isclose(s["idr"], 0.5)
    n = r["none"]
    assert n["mota"] == 0 and n["num_misses"] == 20 and n["mostly_lost"] == 2 and n["recall"] == 0


def hota_by_hand(t, p):
    frames = sorted({r["frame_idx"] for r in t})
    gts = [[r for r in t if r["frame_idx"] == f] for f in frames]
    prs = [[r for r in p if r["frame_idx"] == f] for f in frames]

    def iou(a, b):
        w = max(0, min(a[2], b[2]) - max(a[0], b[0]))
        h = max(0, min(a[3], b[3]) - max(a[1], b[1]))
        u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
        return w * h / u

    sims = [np.array([[iou(a["box"], b["box"]) for b in ps] for a in gs]).reshape(len(gs), len(ps)) for gs, ps in zip(gts, prs)]
    gi = {k: i for i, k in enumerate(sorted({r["id"] for r in t}))}
    pi = {k: i for i, k in enumerate(sorted({r["id"] for ps in prs for r in ps}))}
    pot, gc, pc = np.zeros((len(gi), len(pi))), np.zeros((len(gi), 1)), np.zeros((1, len(pi)))
    for gs, ps, s in zip(gts, prs, sims):
        den = s.sum(0, keepdims=True) + s.sum(1, keepdims=True) - s
        share = np.divide(s, den, out=np.zeros_like(s), where=den > 1e-12)
        for a, g in enumerate(gs):
            gc[gi[g["id"]]] += 1
            for b, q in enumerate(ps):
                pot[gi[g["id"]], pi[q["id"]]] += share[a, b]
        for q in ps:
            pc[0, pi[q["id"]]] += 1
    score = pot / (gc + pc - pot)
    res = []
    for alpha in np.arange(0.05, 0.99, 0.05):
        match, tp, loc = np.zeros_like(pot), 0, 0.0
        for gs, ps, s in zip(gts, prs, sims):
            if not ps:
                continue
            w = np.array([[score[gi[g["id"]], pi[q["id"]]] for q in ps] for g in gs]) * s
            cells = [(a, b, w[a, b]) for a in range(len(gs)) for b in range(len(ps))]
            for a, b, _ in (cells[k] for k in best_pairs(cells, most=False)):
                if s[a, b] >= alpha - 2.3e-16:
                    match[gi[gs[a]["id"]], pi[ps[b]["id"]]] += 1
                    tp, loc = tp + 1, loc + s[a, b]
        fn, fp = gc.sum() - tp, pc.sum() - tp
        ass = (match * match / np.maximum(1, gc + pc - match)).sum() / max(1, tp)
        det = tp / max(1, tp + fn + fp)
        res.append((np.sqrt(det * ass), det, ass, loc / tp if tp else 1.0))
    return np.mean(res, axis=0)


def test_hota_against_definition(spark):
    rng = np.random.default_rng(4)
    truth, pred = [], []
    for f in range(25):
        for i in range(4):
            x, y = 60.0 * i + 2 * f, float(30.0 + 10 * np.sin(f + i))
            truth.append(("C1G1D28", f, i, (x, y, x + 70, y + 50)))
            if rng.random() < 0.85:
                d = rng.normal(0, 8, 2).tolist()
                pred.append(("a", "C1G1D28", f, int((i + f // 9) % 5), (x + d[0], y + d[1], x + 70 + d[0], y + 50 + d[1])))
    t = spark.createDataFrame(truth, f"video_id string, frame_idx int, id long, box {BOX}")
    p = spark.createDataFrame(pred, f"variant string, video_id string, frame_idx int, id long, box {BOX}")
    got = M.hota_scores(M.hota_terms(t, p, p)).first()
    want = hota_by_hand(t.collect(), p.collect())
    assert np.allclose([got[k] for k in ("HOTA", "DetA", "AssA", "LocA")], want)
    alone = M.hota_scores(M.hota_terms(t, p, p), level="all").first()
    assert np.isclose(alone["HOTA"], got["HOTA"])


def test_perfect_and_empty_hota(scene, spark):
    t, _, v = scene
    same = t.withColumn("variant", F.lit("swap"))
    r = {x["variant"]: x for x in M.hota_scores(M.hota_terms(t, same, v)).collect()}
    assert np.isclose(r["swap"]["HOTA"], 1) and r["none"]["HOTA"] == 0 and r["none"]["LocA"] == 1


def test_expected_outputs(scene, spark):
    t, p, v = scene
    n = {r["variant"]: r["n_rows"] for r in M.expected_outputs(p, v, t).collect()}
    assert n == {"swap": 21, "none": 0}


def iou_of(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def events_by_hand(truth, pred, least=0.5):
    """One frame after the other: kept partners, then the most and best of the rest."""
    partner, out = {}, []
    for f in sorted({r["frame_idx"] for r in truth}):
        gs = sorted((r["id"], r["box"]) for r in truth if r["frame_idx"] == f)
        ps = sorted((r["id"], r["box"]) for r in pred if r["frame_idx"] == f)
        valid = {(a, b): iou_of(x, y) for a, x in gs for b, y in ps if iou_of(x, y) >= least}
        hit = {}
        for a, _ in gs:
            b = partner.get(a)
            if (a, b) in valid and b not in hit.values():
                hit[a] = b
        rest = [(a, b, s) for (a, b), s in valid.items() if a not in hit and b not in hit.values()]
        forced = set(hit)
        hit |= {rest[k][0]: rest[k][1] for k in best_pairs(rest, most=True)}
        for a, _ in gs:
            if a in hit:
                switched = a not in forced and partner.get(a, hit[a]) != hit[a]
                out.append((f, "SWITCH" if switched else "MATCH", a, hit[a]))
            else:
                out.append((f, "MISS", a, None))
        out += [(f, "FP", None, b) for b, _ in ps if b not in hit.values()]
        partner |= hit
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_against_one_pass(spark, seed):
    """Crowded boxes, ids that swap, objects that go and come back: most frames leave a choice."""
    rng = np.random.default_rng(seed)
    truth, pred = [], []
    for f in range(60):
        for i in range(6):
            x, y = 25.0 * (i % 3) + 5 * float(np.sin(f / 5 + i)), 200.0 * (i // 3) + 4 * float(np.cos(f / 3 + i))
            if rng.random() < 0.8:
                truth.append(("C1G1D28", f, i, (x, y, x + 60, y + 40)))
            for v in ("a", "b"):
                if rng.random() < 0.85:
                    d = rng.normal(0, 6, 2).tolist()
                    # Variant b renames its ids on the way.
                    pred.append((v, "C1G1D28", f, int(i + (f // 20 if v == "b" else 0)), (x + d[0], y + d[1], x + 60 + d[0], y + 40 + d[1])))
    t = spark.createDataFrame(truth, f"video_id string, frame_idx int, id long, box {BOX}")
    p = spark.createDataFrame(pred, f"variant string, video_id string, frame_idx int, id long, box {BOX}")
    got = M.clear_events(t, p, p, block=8).collect()
    rows = p.collect()
    for v in ("a", "b"):
        mine = sorted(((r["frame_idx"], r["type"], r["gt_id"], r["pred_id"]) for r in got if r["variant"] == v), key=str)
        assert mine == events_by_hand(t.collect(), [r for r in rows if r["variant"] == v])


def test_one_chain_over_all_frames(spark):
    """Two boxes on one place: the partner of the first frame decides every later one."""
    b = (0.0, 0.0, 50.0, 50.0)
    t = spark.createDataFrame([("C1G1D28", f, i, b) for f in range(300) for i in (1, 2)], f"video_id string, frame_idx int, id long, box {BOX}")
    pred = [("a", "C1G1D28", f, i, b if i == 1 or f else (0.0, 0.0, 50.0, 40.0)) for f in range(300) for i in (1, 2)]
    p = spark.createDataFrame(pred, f"variant string, video_id string, frame_idx int, id long, box {BOX}")
    kinds = {(r["type"], r["count"]) for r in M.clear_events(t, p, p, block=16).groupBy("type").count().collect()}
    assert kinds == {("MATCH", 600)}


def test_grid_against_all_boxes(spark):
    rng = np.random.default_rng(8)

    def boxes(n):
        xy, wh = rng.uniform(-300, 3000, (n, 2)), rng.uniform(0, 90, (n, 2))
        wh[:5] = 1500.0  # far wider than a cell
        wh[5:8, 0] = 0.0
        return np.concatenate([xy, xy + wh], 1)

    g, q = boxes(2000), boxes(1500)
    t = spark.createDataFrame([("V", 0, i, tuple(b)) for i, b in enumerate(g.tolist())] + [("V", 0, 9999, None)], f"video_id string, frame_idx int, id long, box {BOX}")
    p = spark.createDataFrame([("a", "V", 0, i, tuple(b)) for i, b in enumerate(q.tolist())], f"variant string, video_id string, frame_idx int, id long, box {BOX}")
    w = (np.minimum(g[:, None, 2:], q[None, :, 2:]) - np.maximum(g[:, None, :2], q[None, :, :2])).clip(0)
    inter = w.prod(2)
    area = lambda b: (b[:, 2:] - b[:, :2]).prod(1)
    iou = inter / np.maximum(area(g)[:, None] + area(q)[None] - inter, 1e-300)
    for least, cell in ((0.0, 64.0), (0.3, 256.0), (0.1, 37.5)):
        got = sorted((r["gt_id"], r["pred_id"]) for r in M.box_pairs(t, p, min_iou=least, cell=cell).collect())
        assert got == [tuple(x) for x in np.argwhere((iou > 0) & (iou >= least)).tolist()]


def test_components_against_search(spark):
    from trackspark.operators.components import components

    rng = np.random.default_rng(3)
    edges = [("k1", int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [("k2", i, i + 1) for i in range(70)]
    edges += [("k2", 5, 5), ("k2", 3, 4), (None, 1, 2), ("k2", None, 2)]
    got = {(r["k"], r["node"]): r["component"] for r in components(spark.createDataFrame(edges, "k string, a long, b long"), ["k"]).collect()}
    around = {}
    for k, a, b in edges:
        if k is not None and a is not None and a != b:
            around.setdefault((k, a), set()).add((k, b))
            around.setdefault((k, b), set()).add((k, a))
    want, seen = {}, set()
    for n in sorted(around):
        if n not in seen:
            todo, group = [n], {n}
            while todo:
                new = around[todo.pop()] - group
                group |= new
                todo += new
            seen |= group
            want |= {m: n[1] for m in group if m != n}
    assert got == want
    assert components(spark.createDataFrame([], "k string, a long, b long"), ["k"]).count() == 0


@pytest.mark.parametrize("wide", [1024, 6])
def test_frame_pairs_tell_what_windows_tell(spark, wide):
    """Pairs folded by frame, narrow and wide, against grid cells and windows; predictions count once, in scored frames only."""
    rng = np.random.default_rng(5)

    def boxes(n, ids, frames):
        x, y = rng.integers(0, 40, n) * 20.0, rng.integers(0, 3, n) * 25.0
        flat = rng.random(n) < 0.05  # without area: scored, but without a pair
        sides = zip(x, y, np.where(flat, x, x + 60.0), y + 30.0)
        return [(f"v{v}", int(f), int(i), tuple(map(float, s))) for v, f, i, s in zip(rng.integers(0, 2, n), rng.integers(0, frames, n), rng.integers(0, ids, n), sides)]

    t = spark.createDataFrame(boxes(300, 9, 30), f"video_id string, frame_idx int, id long, box {BOX}")
    rows = [(str(rng.choice(["a", "b"])), *r) for r in boxes(500, 9, 34)]
    p = spark.createDataFrame(rows, f"variant string, video_id string, frame_idx int, id long, box {BOX}")
    got = M.frame_pairs(t, p, min_iou=0.1, wide=wide).cache()
    w = {k: Window.partitionBy(*M.FRAME, k) for k in ("gt_id", "pred_id")}
    sums = F.sum("iou").over(w["gt_id"]) + F.sum("iou").over(w["pred_id"])
    want = M.box_pairs(t, p, min_iou=0.1).select(
        *M.FRAME,
        "gt_id",
        "pred_id",
        F.round("iou", 9).alias("iou"),
        F.round(F.col("iou") / (sums - F.col("iou")), 9).alias("share"),
        ((F.count("*").over(w["gt_id"]) == 1) & (F.count("*").over(w["pred_id"]) == 1)).alias("alone"),
    )
    met = got.filter("iou IS NOT NULL").withColumns({c: F.round(c, 9) for c in ("iou", "share")}).select(*want.columns)
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, want.collect()))
    counted = got.filter("counts").groupBy(*M.FRAME, "pred_id").count().collect()
    expected = M.scored_predictions(t, p).groupBy(*M.FRAME, "id").count().select(*M.FRAME, "id", "count").collect()
    assert sorted(map(tuple, counted)) == sorted(map(tuple, expected))


def test_pairs_of_the_scores_are_met_once(spark, monkeypatch):
    """CLEAR and the identity counts share the pairs; every truth row has one event, every scored prediction too."""
    from trackspark.plans import eval_queries

    made, fold = [], M.frame_pairs
    monkeypatch.setattr(M, "frame_pairs", lambda *a, **k: made.append(fold(*a, **k)) or made[-1])
    counts, ids = eval_queries._counts(spark, "/root/testdata/sf0.001")
    total = counts.join(ids, M.SEQ).selectExpr(
        "sum(num_objects) - sum(num_detections + num_misses) AS truths",
        "sum(num_predictions) - sum(num_detections + num_false_positives) AS guesses",
        "sum(num_predictions) - sum(idtp + idfp) AS ids",
    )
    assert tuple(total.first()) == (0, 0, 0) and len(made) == 1


def test_distances_of_a_frame_are_added_by_object(spark):
    """Were added in one run over all pairs, which lost more bits than the SQL twin does."""
    from trackspark.operators import frames

    rng = np.random.default_rng(11)
    at = rng.random((40, 6, 2))
    rows = [("v", f, k, 0.0, 0.0, 1.0, 1.0, float(x), float(y), 1.0) for f in range(40) for k, (x, y) in enumerate(at[f])]
    schema = "video_id string, frame_idx int, track_id int, x1 double, y1 double, x2 double, y2 double, cx_norm double, cy_norm double, confidence double"
    got = {r["frame_idx"]: r["mean_centroid_distance"] for r in frames.detection_frames(spark.createDataFrame(rows, schema), changes=False).collect()}
    plain = 0
    for f in range(40):
        d = [[float(np.sqrt((at[f, a, 0] - at[f, b, 0]) ** 2 + (at[f, a, 1] - at[f, b, 1]) ** 2)) for b in range(a + 1, 6)] for a in range(5)]
        total = 0.0
        for row in reversed(d):
            total += _in_one_run([row])
        assert got[f] == total / 15
        plain += got[f] != _in_one_run(d) / 15
    assert plain > 0


def _in_one_run(rows):
    total = 0.0
    for row in rows:
        for x in row:
            total += x
    return total

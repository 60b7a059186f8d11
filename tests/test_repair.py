"""Repair against a plain loop over generated tracks and actions, and cases of its own."""

import random

import pytest

from trackspark.operators import repair
from trackspark.operators.joins import Findings

ACTION = "video_id string, type string, frame int, `from` int, `to` int, id int, protocol_id int, tracking_id int, seq int"
FIELDS = ["video_id", "type", "frame", "from", "to", "id", "protocol_id", "tracking_id", "seq"]
TRACK = "video_id string, frame_idx int, tracking_id int, tracker_score double"
LABEL = "video_id string, bird_id int, time double"
VIDEOS = {"a": 10.0, "b": 25.0, "c": 5.0}


def table(spark, actions):
    return spark.createDataFrame([tuple({"seq": k, **x}.get(c) for c in FIELDS) for k, x in enumerate(actions)], ACTION)


def world(seed):
    """Tracks, labels and actions of three videos; one video has most rows."""
    rng = random.Random(seed)
    tracks = [(v, f, i, round(rng.random(), 3)) for v, n in (("a", 160), ("b", 40), ("c", 25)) for f in range(n) for i in range(5) if rng.random() < 0.8]
    tracks += [("a", None, 2, 0.5), (None, 3, 2, 0.5), ("a", 7, None, 0.5)]
    labels = [(v, rng.randint(1, 3), round(rng.uniform(0, 18), 1)) for v in VIDEOS for _ in range(40)]
    labels += [("a", 1, None), (None, 1, 2.0)]
    acts = []
    for _ in range(14):
        v, f = rng.choice("aab"), rng.randint(0, 150)
        acts.append({"video_id": v, "type": "trim", "from": f, "to": f + rng.randint(0, 25), "id": rng.choice([None, 1, 2, 3])})
        acts.append({"video_id": v, "type": "id_switch", "frame": rng.choice([f, 60, 90]), "from": rng.randint(0, 4), "to": rng.randint(0, 6)})
        ref = rng.choice([None, rng.randint(0, 160)])
        acts.append({"video_id": v, "type": "id_match", "frame": ref, "tracking_id": rng.randint(0, 6), "protocol_id": rng.randint(0, 9)})
    acts.append({"video_id": None, "type": "trim", "from": 25, "to": 50})
    return tracks, labels, acts


def loop(tracks, labels, acts):
    """The three steps one action after the other."""
    trims = [x for x in acts if x["type"] == "trim"]

    def cut(v, f, i):
        return v is not None and f is not None and any(
            t["video_id"] == v and t["from"] <= f <= t["to"] and (t.get("id") is None or t["id"] == i) for t in trims
        )

    def silent(v, at):
        return at is not None and any(
            t.get("id") is None
            and (t["video_id"] == v if t["video_id"] else True)
            and t["from"] / (VIDEOS.get(t["video_id"], 25.0)) <= at <= t["to"] / (VIDEOS.get(t["video_id"], 25.0))
            for t in trims
        )

    rows = [list(r) for r in tracks if not cut(*r[:3])]
    kept = [r for r in labels if not silent(r[0], r[2])]
    for v in VIDEOS:
        switches = {}
        for x in acts:
            if x["type"] == "id_switch" and x["video_id"] == v:
                switches.setdefault(x["frame"], {})[x["from"]] = x["to"]
        for f in sorted(switches):
            for r in rows:
                if r[0] == v and r[1] is not None and r[1] < f and r[2] is not None:
                    r[2] = switches[f].get(r[2], r[2])
        for x in acts:
            if x["type"] == "id_match" and x["video_id"] == v:
                seen = {r[2] for r in rows if r[0] == v and r[1] == x["frame"]}
                if x["frame"] is None or x["tracking_id"] in seen:
                    for r in rows:
                        if r[0] == v and r[2] == x["tracking_id"]:
                            r[2] = x["protocol_id"]
    return sorted(map(repr, map(tuple, rows))), sorted(map(repr, kept))


@pytest.mark.parametrize(("seed", "block"), [(1, 16), (2, 64), (3, 100_000)])
def test_against_loop(spark, seed, block):
    tracks, labels, acts = world(seed)
    fps = spark.createDataFrame(list(VIDEOS.items()), "video_id string, fps double")
    a = table(spark, acts)
    t, l = repair.trim(spark.createDataFrame(tracks, TRACK), spark.createDataFrame(labels, LABEL), a, fps, block=block)
    t = repair.match_ids(repair.merge_switches(t, a, block=block), a)
    got = sorted(repr(tuple(r)) for r in t.select("video_id", "frame_idx", "bird_id", "tracker_score").collect())
    want, want_labels = loop(tracks, labels, acts)
    assert got == want
    assert sorted(repr(tuple(r)) for r in l.select("video_id", "bird_id", "time").collect()) == want_labels


def test_nothing_to_do(spark):
    t = spark.createDataFrame([("a", 1, 2, 0.5), ("a", 1, 2, 0.5)], TRACK)
    l = spark.createDataFrame([("a", 1, 2.0)], LABEL)
    none = table(spark, [])
    fps = spark.createDataFrame([("a", 10.0)], "video_id string, fps double")
    out, labels = repair.process_tracks(t, l, none, fps)
    assert out.columns == ["video_id", "frame_idx", "bird_id", "tracker_score"] and out.count() == 2 and labels.count() == 1


def test_all_unfilled_entries_are_reported(spark):
    gaps = [{"video_id": f"v{k}", "type": "id_switch", "frame": 1, **({"from": 1} if k % 2 else {"to": 1})} for k in range(60)]
    gaps += [{"video_id": "w", "type": "id_match", "protocol_id": 4}, {"video_id": "w", "type": "trim", "from": 1, "to": 2}]
    with pytest.raises(Findings, match="61 action entries are unfilled") as found:
        repair.require_filled(table(spark, gaps))
    missing = {r["video_id"]: r["missing"] for r in found.value.table.collect()}
    assert len(missing) == 61 and missing["v0"] == "from" and missing["v1"] == "to" and missing["w"] == "tracking_id"


def test_worst_id_brute_force(spark):
    rng = random.Random(4)
    rows = [(v, f, i, rng.choice([0.2, 0.5, 0.9, None])) for v in "xy" for f in range(0, 2000, 7) for i in range(4)]
    periods = []
    for _ in range(25):
        a = rng.randint(0, 1900)
        periods.append((rng.choice("xy"), a, a + rng.randint(0, 1500), rng.sample(range(6), 2)))
    t = spark.createDataFrame(rows, TRACK)
    p = spark.createDataFrame(periods, "video_id string, start int, end int, ids array<int>")
    got = {(r["video_id"], r["start"], r["end"]): r["worst_id"] for r in repair.worst_id(p, t).collect()}
    for v, a, b, ids in periods:
        means = []
        for pos, i in enumerate(ids):
            s = [x[3] for x in rows if x[0] == v and a <= x[1] <= b and x[2] == i and x[3] is not None]
            if s:
                means.append((round(sum(s) / len(s), 9), pos, i))
        assert got[v, a, b] == (min(means)[2] if means else ids[0])


def test_template_has_overlap_trims(spark):
    """An overlap becomes a trim of the id that was seen with the lower score."""
    issues = spark.createDataFrame(
        [("x", "overlap", [1, 2], 0, 9, None, None)], "video_id string, type string, ids array<int>, start int, end int, id int, gained array<int>"
    )
    t = spark.createDataFrame([("x", f, i, 0.9 if i == 1 else 0.4) for f in range(10) for i in (1, 2)], TRACK)
    birds = spark.createDataFrame([("x", "3", "blue")], "video_id string, protocol_id string, description string")
    fps = spark.createDataFrame([("x", 5.0)], "video_id string, fps double")
    out = {r["type"]: r for r in repair.action_template(issues, t, birds, fps).collect()}
    assert (out["trim"]["id"], out["trim"]["from"], out["trim"]["to"], out["trim"]["cause"]) == (2, 0, 9, "overlap")
    assert out["id_match"]["protocol_id"] == "3"

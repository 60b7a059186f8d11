import json

import pytest
from pyspark.sql import functions as F

from trackspark import schemas
from trackspark.functions import text
from trackspark.operators import joins, labels, moteval, sequences
from trackspark.sources import readers, writers

DIR = "C1G3_Test_1_day_28_1_Camera_8_2025_02_04_10_59_56_3"


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_actions(spark, tmp_path):
    put(tmp_path / DIR / "tracking_postprocessing.json", [
        {"type": "trim", "cause": "overlap", "from": 3, "to": 9, "id": 1, "_time": "x"},
        {"type": "merged_object", "from": 1},
        {"type": "id_match", "protocol_id": "2664", "tracking_id": None, "frame": None},
    ])
    rows = readers.actions(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["type"] for r in rows] == ["trim", "id_match"]
    assert {r["video_id"] for r in rows} == {"C1G3D28"} and rows[0]["from"] == 3


def test_chunk_info(spark, tmp_path):
    put(tmp_path / DIR / "chunk_info.json", {"chunks": [
        {"chunk_idx": 0, "frame_range": [0, 10], "model_type": "video", "prompt_points": {}, "timing": {"elapsed_seconds": 5.0, "num_frames": 10}},
        {"chunk_idx": 1, "frame_range": [10, 30], "model_type": "tracker", "prompt_points": {"3": [[1, 2], [3, 4]]}, "timing": {"elapsed_seconds": 5.0, "num_frames": 20}},
    ]})
    c = readers.chunk_info(spark, str(tmp_path))
    assert {(r["start"], r["end"]) for r in c.collect()} == {(0, 10), (10, 30)}
    assert sorted((r["id"], r["x"], r["y"]) for r in readers.prompt_points(c).collect()) == [(3, 1.0, 2.0), (3, 3.0, 4.0)]
    from trackspark.operators.chunks import chunk_throughput

    assert chunk_throughput(c).first()["fps"] == 3.0


def test_tracking_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, [0.0, 0.0, 2.0, 2.0], "a", [2, 2], 0.5, None, 0, "video", True)], schemas.TRACKING_RAW)
    df.write.parquet(str(tmp_path / DIR / "tracking_outputs.parquet"))
    t = readers.tracking_outputs(spark, str(tmp_path), name="*.parquet")
    assert t.count() == 1 and "tracking_id" in t.columns
    rows = moteval.mot_rows(t.withColumn("variant", F.lit("e"))).withColumn("video_id", F.lit("v"))
    assert rows.first()["line"] == "0,1,0.00,0.00,2.00,2.00,1.0000,-1,-1,-1"


def test_mot_text(spark, tmp_path):
    put(tmp_path / "E" / "C1G2D29.txt", "3,1,10.00,20.00,5.00,6.00,0.9000,-1,-1,-1\n")
    r = readers.mot_text(spark, str(tmp_path)).first()
    assert (r["variant"], r["video_id"], r["frame_idx"], r["x"], r["h"]) == ("E", "C1G2D29", 3, 10.0, 6.0)
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "v", f, i, f"{f},{i}") for f in range(5) for i in (2, 1)], "variant string, video_id string, frame_idx int, id int, line string")
    writers.mot_text(rows, out)
    assert spark.read.text(out).count() == 10


def test_annotations(spark, tmp_path):
    put(tmp_path / "task_0" / "annotations.json", [{"tracks": [
        {"shapes": [{"frame": 1, "type": "rectangle", "outside": False, "points": [1, 2, 4, 6]}, {"frame": 2, "type": "rectangle", "outside": True, "points": [0, 0, 1, 1]}]},
        {"shapes": [{"frame": 1, "type": "polygon", "points": [0, 0, 1, 1]}, {"frame": 3, "type": "rectangle", "points": [0, 0, 1, 2]}]},
    ]}])
    s = readers.annotation_boxes(spark, str(tmp_path))
    drawn = sorted((r["id"], r["frame_idx"], r["w"], r["h"]) for r in s.filter("kind = 'drawn'").collect())
    assert drawn == [(1, 1, 3.0, 4.0), (2, 3, 1.0, 2.0)]
    assert {(r["id"], r["drawn"], r["outside"]) for r in readers.annotation_counts(s).collect()} == {(1, 1, 1), (2, 1, 0)}


def test_manifest_and_latest_run(spark, tmp_path):
    put(tmp_path / "m.csv", "video_id,cage,group,day,path,scan_dir,selected,notes,difficulty,rank_in_cage\na,C1,G1,28,p,s,True,,5,1\nb,C1,G2,28,p,s,False,,4,2\nc,C2,G2,28,p,s,1,,4,1\n")
    assert {r["video_id"] for r in readers.manifest(spark, str(tmp_path / "m.csv"), selected_only=True).collect()} == {"a", "c"}
    f = spark.createDataFrame([("x", "2026_a"), ("x", "2026_b"), ("y", "2025_z")], "stem string, run string")
    assert {tuple(r) for r in readers.latest_runs(f).collect()} == {("x", "2026_b"), ("y", "2025_z")}


def test_nested_shapes(spark):
    rows = [
        (0, [1, 2], [[0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]], [0.5], {"2": 0.7}, None, None),
        (1, None, None, None, None, [(5, [0.0, 0.0, 1.0, 1.0], 0.1, None)], None),
        (2, None, None, None, None, None, [(6, [0.0, 0.0, 1.0, 1.0], None, 0.2)]),
    ]
    got = {(r["frame_idx"], r["id"]): (r["score"], r["tracker_score"]) for r in readers.flatten_frames(spark.createDataFrame(rows, schemas.NESTED_FRAMES)).collect()}
    assert got == {(0, 1): (0.5, None), (0, 2): (None, 0.7), (1, 5): (0.1, None), (2, 6): (None, 0.2)}


def test_writers(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a", 0), (2, 1, "a", 0)], "frame_idx int, object_id int, x string, version int")
    new = spark.createDataFrame([(2, 1, "b", 1), (3, 1, "b", 1)], old.schema)
    got = {r["frame_idx"]: r["x"] for r in writers.upsert(old, new, ["frame_idx", "object_id"], "version").collect()}
    assert got == {1: "a", 2: "b", 3: "b"}
    path = str(tmp_path / "docs")
    writers.video_documents(spark.createDataFrame([("v", 2), ("v", 1), ("w", 3)], "video_id string, start int"), path)
    d = {r["video_id"]: [e["start"] for e in r["entries"]] for r in spark.read.json(path).collect()}
    assert d == {"v": [1, 2], "w": [3]}
    writers.dataset(spark.createDataFrame([("v", 1, 2)], "video_id string, bird_id int, frame_idx int"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


@pytest.mark.parametrize("name,want", [(DIR, "C1G3D28"), ("C4G2_x_day_29_y", "C4G2D29"), ("nothing", None), ("C1G1_Test", None)])
def test_names(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(text.video_id_of("n")).first()[0] == want


def test_text_functions(spark):
    df = spark.createDataFrame([("a b/c__d",)], "n string")
    r = df.select(
        text.safe_name("n").alias("a"), text.safe_name(F.lit("%%")).alias("b"), text.clock(F.lit(1510)).alias("c"),
        text.model_size(F.lit("X-ViTL-16")).alias("d"), text.model_size(F.lit("prism_large")).alias("e"), text.model_size(F.lit("x")).alias("f"),
        text.stem_parts(F.lit(DIR)).alias("g"), text.age_of(F.lit("week 1 (age 29 days).xlsx")).alias("h"),
        text.spans_text(text.parse_spans(F.lit("1-2;30-44"))).alias("i"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == ("a_b_c_d", "video", "01:00.40", "vitl", "vitl", None)
    assert (r["g"]["cage"], r["g"]["group"], r["g"]["day"], r["h"], r["i"]) == ("C1", "G3", 28, 29, "1-2;30-44")


def test_rarest_class(spark):
    rows = [("locomotor",)] * 10 + [("locomotor, worm",)] * 2 + [("worm",), ("none",)]
    out = labels.resolve_dual_groups(spark.createDataFrame(rows, "behav_group string"))
    assert {r["behav_label"] for r in out.filter(F.col("behav_group").contains(",")).collect()} == {"worm"}


def test_keys_and_frames(spark):
    a = spark.createDataFrame([("v", 1), ("v", 2), ("v", 2)], "video_id string, frame_idx int")
    b = spark.createDataFrame([("v", 2), ("v", 3)], a.schema)
    assert {(r["frame_idx"], r["side"]) for r in joins.key_difference(a, b, ["video_id", "frame_idx"]).collect()} == {(1, "left"), (3, "right")}
    assert joins.duplicate_keys(a, ["video_id", "frame_idx"]).first()["n"] == 2
    assert readers.frame_points(a, b, offsets=(-1, 0)).count() == 3


@pytest.mark.parametrize("t", [8, 10, 50, 63, 100, 125, 126])
def test_segment_pool(spark, t):
    import numpy as np
    from trackspark.functions import pooling

    x = np.random.default_rng(t).normal(size=(t, 3))
    df = spark.createDataFrame([(x.tolist(),)], "seq array<array<double>>")
    for k in (1, 2, 10):
        got = np.array(df.select(pooling.segment_pool("seq", k)).first()[0])
        want = [x[i * t // k : -(-(i + 1) * t // k)].mean(0) for i in range(k)]
        assert np.allclose(got, want)
    assert np.allclose(df.select(pooling.mean_pool("seq")).first()[0], x.mean(0))

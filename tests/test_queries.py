"""A sample of the registered queries against their SQL twins, and the driver contract."""

import duckdb
import pytest
from check_queries import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "frame_metrics",
    "occlusion_periods",
    "low_score_periods",
    "labels_long",
    "merge_id_switches",
    "frame_features",
    "window_summary",
    "video_summary",
    "adaptive_chunks",
    "mask_geometry",
    "mask_frame_metrics",
    "mot_box_pairs",
    "segment_pool_zscored",
    "fold_summary",
    "correlations",
    "linear_cka",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    ok, note = compare(spark, connect(SF), SF, name)
    assert ok, note


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """One frame whose mean overlap, 0.0535546875, is a tie at nine digits but for the last bit of its double."""
    folder = tmp_path_factory.mktemp("tied")
    rows = [(1, 44.0, 0.06, 0.04), (2, 24.0, 0.1, 0.0), (3, 46.0, 0.06, 0.08), (4, 17.0, 0.06, 0.03), (7, 48.0, 0.01, 0.03)]
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame([(693745, *r) for r in rows], schema).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["frame_metrics", "mask_frame_metrics"])
def test_ties_round_as_in_the_sql(spark, tied, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tied}/lineitem.parquet/*.parquet')")
    ok, note = compare(spark, con, tied, name)
    assert ok, note


def test_rounding_of_doubles(spark):
    from trackspark.plans.scan_queries import rounded

    values = [0.053554687499999996, -0.053554687499999996, 1e305, float("inf"), 0.0, None]
    got = [r["x"] for r in rounded(spark.createDataFrame([(v,) for v in values], "x double"), "x", digits=9).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 9)", [v]).fetchone()[0] for v in values]
    assert got == want == [0.053554688, -0.053554688, 1e305, float("inf"), 0.0, None]


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_drop_empty(spark):
    from trackspark.functions import rle
    from trackspark.operators import masks

    df = spark.createDataFrame([(rle.encode_runs([100]),), (rle.encode_runs([3, 5, 92]),)], "counts string")
    assert masks.drop_empty(df).count() == 1


def test_whole_dataset_and_features(spark):
    """The end-to-end jobs on mask tracks of the views."""
    from trackspark.functions import rle
    from trackspark.plans import pipelines, views

    m = views.masks(spark, SF).withColumnRenamed("bird_id", "tracking_id").withColumn("counts", rle.rle_encode("runs"))
    t = m.select("video_id", "tracking_id", "frame_idx", "bbox", "counts", "size", "tracker_score")
    acts = views.actions(spark, SF)
    tracks, labels = pipelines.build_dataset(t, views.label_sheet(spark, SF), acts, views.videos(spark, SF), min_coverage=0.2)
    assert tracks.columns[:3] == ["video_id", "bird_id", "frame_idx"] and tracks.count() > 0
    out = pipelines.extract_features(tracks)
    windows = out["features_windowed"]
    assert windows.count() == labels.count() == out["sequences"].count()
    assert len(windows.columns) == 3 + 17 * 9 + 1
    found = pipelines.find_issues(t, views.videos(spark, SF), spark.createDataFrame([("C1G1D28", "1", "x")], "video_id string, protocol_id string, description string"))
    assert found["issues"].count() > 0 and found["template"].count() > 0
    res = pipelines.scan(views.detections(spark, SF), views.videos(spark, SF))
    assert res["chunks"].count() == 30 and res["frames"].count() > 0


def test_frames_read_stored_detections(spark):
    """Frame metrics read their detections several times: none of the reads computes them again."""
    from trackspark.plans import scan_queries as S

    plain, full = S.frame_metrics(spark, SF, changes=False), S.frame_metrics(spark, SF)
    assert not [f for f in full.inputFiles() + plain.inputFiles() if "lineitem" in f]
    keys = ["video_id", "frame_idx", "num_objects", "separation_score"]
    assert sorted(map(tuple, plain.select(keys).collect())) == sorted(map(tuple, full.select(keys).collect()))
    assert "is_object_count_change" not in plain.columns

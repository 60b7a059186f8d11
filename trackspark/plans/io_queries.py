"""Registered queries: sinks written to the shared folder and read back by the sources, streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark import schemas
from trackspark.operators import chunks, labels
from trackspark.plans import dataset_queries as D
from trackspark.plans import oracle as O
from trackspark.plans import scan_queries as S
from trackspark.plans import views
from trackspark.session import shared_folder
from trackspark.sources import readers, writers
from trackspark.streaming import stability, upsert


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stem(video: str = "video_id"):
    """A recording's directory name, from which the sources take the video id back."""
    v = F.col(video)
    return F.concat(F.substring(v, 1, 4), F.lit("_Test_1_day_"), F.substring(v, 6, 2), F.lit("_1_Camera_1"))


def _shaped(df: DataFrame, schema: str, **given) -> DataFrame:
    """The columns of a file schema, NULL where nothing is given."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    return df.select("stem", *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def q_tracking_outputs(spark, sf):
    t = views.tracks(spark, sf).withColumn("stem", _stem())
    rows = _shaped(t, schemas.TRACKING_RAW, frame_idx=F.col("frame_idx"), object_id=F.col("tracking_id"), bbox=F.col("bbox"), tracker_score=F.col("tracker_score"))
    path = _folder(spark, "tracking")
    writers.dataset(rows, path, partition=["stem"])
    back = readers.tracking_outputs(spark, path, name="*.parquet")
    return back.select("video_id", "frame_idx", "tracking_id", *[F.round(F.get("bbox", F.lit(k)), 6).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])


SQL_TRACKING = O.r6(
    O._cte(O.DET) + "SELECT video_id, frame_idx, track_id AS tracking_id, x1, y1, x2, y2 FROM det", "x1", "y1", "x2", "y2"
)


def q_detection_files(spark, sf):
    d = views.detections(spark, sf).withColumn("stem", _stem())
    rows = _shaped(d, schemas.DETECTIONS, frame=F.col("frame_idx"), **{c: F.col(c) for c in ("track_id", "x1", "y1", "x2", "y2", "cx_norm", "cy_norm", "confidence")})
    path = _folder(spark, "detections")
    # Written in two goes: the sink appends.
    for half in (0, 1):
        writers.append(rows.filter(F.pmod(F.hash("track_id"), F.lit(2)) == half).withColumn("video", F.col("stem")).drop("stem"), f"{path}/{half}")
    out = None
    for half in (0, 1):
        part = spark.read.parquet(f"{path}/{half}")
        out = part if out is None else out.unionByName(part)
    writers.dataset(out, f"{path}/all", partition=["video"])
    back = readers.detections(spark, f"{path}/all", name="*.parquet")
    return S.rounded(back.select("video_id", "frame_idx", "track_id", "x1", "y1", "x2", "y2", "confidence"), "x1", "y1", "x2", "y2", "confidence")


SQL_DETECTIONS = O.r6(
    O._cte(O.DET) + "SELECT video_id, frame_idx, track_id, x1, y1, x2, y2, confidence FROM det", "x1", "y1", "x2", "y2", "confidence"
)


def q_label_sheet_csv(spark, sf):
    """The wide label table through a CSV report and back, then long labels."""
    path = _folder(spark, "sheet")
    writers.csv_report(views.label_sheet(spark, sf), path, order=("sheet", "age", "min", "sek"))
    return labels.resolve_dual_groups(labels.long_labels(readers.label_sheets(spark, path)))


def q_manifest_csv(spark, sf):
    """Videos with many frames are selected in a manifest; only these rows come back."""
    v = views.videos(spark, sf)
    rows = v.select(
        "video_id",
        F.substring("video_id", 1, 2).alias("cage"),
        F.substring("video_id", 3, 2).alias("group"),
        F.substring("video_id", 6, 2).cast("int").alias("day"),
        F.lit("p").alias("path"),
        F.lit("s").alias("scan_dir"),
        F.when(F.col("total_frames") % 2 == 0, F.lit("True")).otherwise(F.lit("False")).alias("selected"),
        F.lit("a, b").alias("notes"),
        F.col("total_frames").alias("difficulty"),
        F.lit(1).alias("rank_in_cage"),
    )
    path = _folder(spark, "manifest")
    writers.csv_report(rows, path, order=("video_id",))
    return readers.manifest(spark, path, selected_only=True).select("video_id", "cage", "group", "day", "notes", "difficulty")


SQL_MANIFEST = f"""SELECT video_id, substr(video_id, 1, 2) AS cage, substr(video_id, 3, 2) AS "group",
    CAST(substr(video_id, 6, 2) AS INTEGER) AS day, 'a, b' AS notes, n AS difficulty
    FROM (SELECT {O.video('o_orderkey')} AS video_id, CAST(max(o_orderkey // 30) + 1 AS INTEGER) AS n FROM orders GROUP BY 1) WHERE n % 2 = 0"""


def q_video_documents(spark, sf):
    """Action entries as one JSON document per video, read back and opened."""
    path = _folder(spark, "documents")
    acts = views.actions(spark, sf).select("video_id", "type", "frame", "from", "to", "seq")
    writers.video_documents(acts, path, order=("seq", "type"))
    back = spark.read.json(path).select("video_id", F.inline("entries"))
    return back.select("video_id", "type", *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("frame", "from", "to")])


SQL_DOCUMENTS = (
    O._cte(*D.ACT)
    + """SELECT video_id, 'trim' AS type, -1 AS frame, a AS "from", b AS "to" FROM cuts
    UNION ALL SELECT video_id, 'id_switch', frame, old, new FROM sw"""
)


def q_upsert_stream(spark, sf):
    """The two halves of ``upsert_latest`` as two files of a stream, upserted batch by batch."""
    d = views.detections(spark, sf).select("video_id", "frame_idx", "track_id", "confidence")
    old = d.withColumn("version", F.lit(0))
    new = d.select("video_id", "frame_idx", (F.col("track_id") % 7 + 1).alias("track_id"), "confidence", F.lit(1).alias("version"))
    path = _folder(spark, "upsert")
    for part in (old, new):
        writers.append(part, f"{path}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        keys = ["video_id", "frame_idx", "track_id"]
        query = upsert.start_upsert(stream, f"{path}/out", f"{path}/log", keys=keys, order="version")
        query.processAllAvailable()
        query.stop()
    return upsert.current(spark, f"{path}/out", keys=keys)


def q_stability_stream(spark, sf):
    """The trigger over a stream: the frames of every chunk arrive in two batches."""
    m = S.frame_metrics(spark, sf).select(
        "video_id",
        F.floor(F.col("frame_idx") / 200).cast("int").alias("chunk_idx"),
        "frame_idx",
        F.col("max_pairwise_bbox_iou").alias("max_iou"),
        "num_objects",
    )
    path = _folder(spark, "stability")
    for late in (False, True):
        writers.append(m.filter((F.col("frame_idx") % 200 >= 100) == late), f"{path}/in")
        stream = spark.readStream.schema(m.schema).parquet(f"{path}/in")
        hits = stability.stability_stream(stream, limit=0.2, window=5, cooldown=20, ends=F.col("frame_idx") % 200 == 199)
        query = hits.writeStream.format("parquet").option("checkpointLocation", f"{path}/log").option("path", f"{path}/out").outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    out = spark.read.schema("video_id string, chunk_idx int, frame_idx int, max_iou double").parquet(f"{path}/out")
    return S.rounded(out, "max_iou")


def _documents(df: DataFrame, path: str, folder: str = "stem") -> None:
    """One JSON text a folder, as annotation tools and trackers leave them."""
    df.select(folder, "text").write.partitionBy(folder).text(path)


def q_action_files(spark, sf):
    """Correction actions as one JSON list a video; entries of other types are not read."""
    a = views.actions(spark, sf).withColumn("stem", _stem())
    item = F.struct("seq", "type", "frame", "from", "to", "id")
    other = F.array(F.lit('{"type":"merged_object","from":1}'))
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.to_json(x))
    docs = a.groupBy("stem").agg(F.concat(F.lit("["), F.array_join(F.concat(other, lines), ","), F.lit("]")).alias("text"))
    path = _folder(spark, "actions")
    _documents(docs, path)
    back = readers.actions(spark, path, name="*.txt")
    return back.select("video_id", "type", *[F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in ("frame", "from", "to", "id")])


SQL_ACTION_FILES = (
    O._cte(*D.ACT)
    + """SELECT video_id, 'trim' AS type, -1 AS frame, a AS "from", b AS "to", coalesce(id, -1) AS id FROM cuts
    UNION ALL SELECT video_id, 'id_switch', frame, old, new, -1 FROM sw"""
)


def q_chunk_files(spark, sf):
    """Chunk descriptions as JSON, read back: throughput and prompt points of every video."""
    v = views.videos(spark, sf).withColumn("stem", _stem())
    lo = lambda k: k * 100
    hi = lambda k: F.least((k + 1) * 100, F.col("total_frames"))
    chunk = lambda k: F.struct(
        k.alias("chunk_idx"),
        F.array(lo(k), hi(k)).alias("frame_range"),
        F.lit("video").alias("model_type"),
        F.create_map(F.lit("3"), F.array(F.array(k * 1.0, k + 0.5))).alias("prompt_points"),
        F.struct((hi(k) - lo(k)).alias("num_frames"), ((hi(k) - lo(k)) / 8.0).alias("elapsed_seconds")).alias("timing"),
    )
    many = F.sequence(F.lit(0), F.ceil(F.col("total_frames") / 100).cast("int") - 1)
    docs = v.select("stem", F.to_json(F.struct(F.transform(many, chunk).alias("chunks"))).alias("text"))
    path = _folder(spark, "chunks")
    _documents(docs, path)
    info = readers.chunk_info(spark, path, name="*.txt")
    points = readers.prompt_points(info).groupBy("video_id").agg(F.count("*").alias("points"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))
    return chunks.chunk_throughput(info).join(points, "video_id").select("video_id", "chunks", "num_frames", "elapsed_seconds", "fps", "points", "sum_x", "sum_y")


SQL_CHUNK_FILES = f"""WITH v AS (SELECT {O.video('o_orderkey')} AS video_id, max(o_orderkey // 30) + 1 AS n FROM orders GROUP BY 1),
    c AS (SELECT video_id, n, CAST(ceil(n / 100) AS BIGINT) AS k FROM v)
    SELECT video_id, k AS chunks, n AS num_frames, n / 8.0::DOUBLE AS elapsed_seconds, 8.0::DOUBLE AS fps, k AS points,
    k * (k - 1) / 2 AS sum_x, k * (k - 1) / 2 + k * 0.5::DOUBLE AS sum_y FROM c"""


def q_annotation_files(spark, sf):
    """Drawn boxes as annotation tasks (a track for each id), read back; polygons are left out."""
    d = views.detections(spark, sf).filter(F.col("track_id").isNotNull())
    shape = F.struct(
        F.col("frame_idx").alias("frame"),
        F.when(F.col("frame_idx") % 11 == 3, "polygon").otherwise("rectangle").alias("type"),
        (F.col("frame_idx") % 7 == 2).alias("outside"),
        F.array("x1", "y1", "x2", "y2").alias("points"),
    )
    per = d.groupBy("video_id", "track_id").agg(F.collect_list(shape).alias("shapes"))
    # Track positions are ids: ids that a video lacks are tracks without shapes.
    have = F.map_from_entries(F.collect_list(F.struct("track_id", "shapes")))
    slots = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.struct(F.coalesce(have[k], F.array().cast(per.schema["shapes"].dataType)).alias("shapes")))
    docs = per.groupBy(F.col("video_id").alias("task")).agg(F.to_json(F.struct(slots.alias("tracks"))).alias("text"))
    path = _folder(spark, "annotations")
    _documents(docs, path, "task")
    rows = readers.annotation_boxes(spark, path, name="*.txt").withColumn("video_id", F.regexp_replace("task", "^task=", ""))
    return S.rounded(rows.select("video_id", "id", "frame_idx", "kind", "x", "y", "w", "h"), "x", "y", "w", "h")


SQL_ANNOTATION_FILES = O.r6(
    O._cte(O.DET)
    + """SELECT video_id, track_id AS id, frame_idx, CASE WHEN frame_idx % 7 = 2 THEN 'outside' ELSE 'drawn' END AS kind,
    x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM det WHERE frame_idx % 7 = 2 OR frame_idx % 11 <> 3""",
    "x",
    "y",
    "w",
    "h",
)


def q_scan_summaries(spark, sf):
    """One summary a run and video; the last run of each video counts."""
    v = views.videos(spark, sf).withColumn("stem", _stem())
    runs = v.withColumn("run", F.explode(F.array(F.lit("2026_a"), F.lit("2026_b"))))
    runs = runs.withColumn("fps", F.when(F.col("run") == "2026_b", F.col("fps")).otherwise(F.lit(1.0)))
    last = readers.latest_runs(runs, stem="stem", run="run")
    rows = last.select("stem", "run", "total_frames", (F.col("total_frames") / F.col("fps")).alias("video_duration_seconds"), "fps", F.lit(2).alias("num_occlusion_periods"))
    path = _folder(spark, "summaries")
    writers.dataset(rows, path, partition=["stem", "run"])
    return readers.scan_fps(spark, path, name="*.parquet")


SQL_SCAN_SUMMARIES = f"""SELECT {O.video('o_orderkey')} AS video_id, 25.0::DOUBLE AS fps, CAST(max(o_orderkey // 30) + 1 AS INTEGER) AS total_frames,
    2 AS num_occlusion_periods FROM orders GROUP BY 1"""


def q_nested_frames(spark, sf):
    """Frames in the three accepted nested shapes, flattened again."""
    d = views.detections(spark, sf)
    one = F.struct(F.col("track_id").alias("id"), F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("confidence").alias("score"), "tracker_score")
    g = d.groupBy("video_id", "frame_idx").agg(F.sort_array(F.collect_list(one)).alias("all"))
    kind = F.col("frame_idx") % 3
    pick = lambda name: F.when(kind == 0, F.transform("all", lambda x: x[name]))
    by_id = F.when(kind == 0, F.map_from_entries(F.transform("all", lambda x: F.struct(x["id"].cast("string"), x["tracker_score"]))))
    nested = g.select(
        "video_id",
        "frame_idx",
        pick("id").alias("object_ids"),
        pick("bbox").alias("boxes"),
        pick("score").alias("scores"),
        by_id.alias("obj_id_to_tracker_score"),
        F.when(kind == 1, F.col("all")).alias("detections"),
        F.when(kind == 2, F.col("all")).alias("instances"),
    )
    out = readers.flatten_frames(nested)
    return S.rounded(out.select("video_id", "frame_idx", "id", *[F.get("bbox", F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))], "score", "tracker_score"), "x1", "y1", "x2", "y2", "score", "tracker_score")


SQL_NESTED_FRAMES = O.r6(
    O._cte(O.DET) + "SELECT video_id, frame_idx, track_id AS id, x1, y1, x2, y2, confidence AS score, tracker_score FROM det",
    "x1",
    "y1",
    "x2",
    "y2",
    "score",
    "tracker_score",
)


def q_carried_points(spark, sf):
    """Rows of the frames around every hundredth frame."""
    d = views.detections(spark, sf).select("video_id", "frame_idx", "track_id")
    wanted = d.filter(F.col("frame_idx") % 100 == 50).select("video_id", "frame_idx").distinct()
    return readers.frame_points(d, wanted, offsets=(-1, 0, 2))


SQL_CARRIED_POINTS = (
    O._cte(O.DET)
    + """SELECT video_id, frame_idx, track_id FROM det WHERE EXISTS (SELECT 1 FROM det w WHERE w.video_id = det.video_id
    AND w.frame_idx % 100 = 50 AND det.frame_idx - w.frame_idx IN (-1, 0, 2))"""
)


QUERIES = {
    "action_files": (q_action_files, SQL_ACTION_FILES),
    "chunk_files": (q_chunk_files, SQL_CHUNK_FILES),
    "annotation_files": (q_annotation_files, SQL_ANNOTATION_FILES),
    "scan_summaries": (q_scan_summaries, SQL_SCAN_SUMMARIES),
    "nested_frames": (q_nested_frames, SQL_NESTED_FRAMES),
    "carried_points": (q_carried_points, SQL_CARRIED_POINTS),
    "tracking_outputs": (q_tracking_outputs, SQL_TRACKING),
    "detection_files": (q_detection_files, SQL_DETECTIONS),
    "label_sheet_csv": (q_label_sheet_csv, D.SQL_LABELS),
    "manifest_csv": (q_manifest_csv, SQL_MANIFEST),
    "video_documents": (q_video_documents, SQL_DOCUMENTS),
    "upsert_stream": (q_upsert_stream, S.SQL_UPSERT),
    "stability_stream": (q_stability_stream, S.SQL_STABILITY),
}

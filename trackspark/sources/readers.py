"""Sources: files of one kind below a root become one DataFrame, the video id from the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark import schemas
from trackspark.functions import text

PATH = "_metadata.file_path"


def _below(spark: SparkSession, name: str):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)


def path_part(from_end: int, path: str | Column = PATH) -> Column:
    """A component of the file path, counted from the end (0 = file name)."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.get(parts, F.size(parts) - 1 - from_end)


def tracking_outputs(spark: SparkSession, root: str, *, name: str = "tracking_outputs.parquet") -> DataFrame:
    """Raw tracking rows of all videos below ``root``; object_id becomes tracking_id."""
    df = _below(spark, name).schema(schemas.TRACKING_RAW).parquet(root)
    return df.withColumn("video_id", text.video_id_of(path_part(1))).withColumnRenamed("object_id", "tracking_id")


def detections(spark: SparkSession, root: str, *, name: str = "yolo_tracking.parquet") -> DataFrame:
    df = _below(spark, name).schema(schemas.DETECTIONS).parquet(root)
    return df.withColumn("video_id", text.video_id_of(path_part(1))).withColumnRenamed("frame", "frame_idx")


def scan_fps(spark: SparkSession, root: str, *, name: str = "yolo_scan_summary.parquet") -> DataFrame:
    """(video_id, fps, total_frames, num_occlusion_periods) from one-row summaries."""
    df = _below(spark, name).schema(schemas.SCAN_SUMMARY).parquet(root)
    video = text.video_id_of(path_part(2))
    return df.withColumn("video_id", video).groupBy("video_id").agg(
        F.first("fps", True).alias("fps"),
        F.first("total_frames", True).alias("total_frames"),
        F.first("num_occlusion_periods", True).alias("num_occlusion_periods"),
    )


def latest_runs(files: DataFrame, *, stem: str = "stem", run: str = "run") -> DataFrame:
    """Keep the rows of the lexicographically last run of every stem."""
    last = files.groupBy(stem).agg(F.max(run).alias(run))
    return files.join(last, [stem, run], "left_semi")


def actions(spark: SparkSession, root: str, *, name: str = "tracking_postprocessing.json") -> DataFrame:
    """Correction actions with their list position; entries of other types are ignored."""
    df = _below(spark, name).option("multiLine", "true").schema(schemas.ACTIONS).json(root)
    # A file is one array: its rows come in order inside one partition.
    out = df.withColumns({"video_id": text.video_id_of(path_part(1)), "seq": F.monotonically_increasing_id()})
    return out.filter(F.col("type").isin("trim", "id_switch", "id_match"))


def chunk_info(spark: SparkSession, root: str, *, name: str = "chunk_info.json") -> DataFrame:
    """One row per chunk: range, model type, prompt points by integer id, timing."""
    df = _below(spark, name).option("multiLine", "true").schema(schemas.CHUNK_INFO).json(root)
    rows = df.select(text.video_id_of(path_part(1)).alias("video_id"), F.posexplode("chunks").alias("pos", "c"))
    points = F.transform_keys("c.prompt_points", lambda k, _: k.cast("int"))
    return rows.select(
        "video_id",
        F.col("pos").alias("chunk_idx"),
        F.get("c.frame_range", F.lit(0)).alias("start"),
        F.get("c.frame_range", F.lit(1)).alias("end"),
        "c.model_type",
        F.when(F.size("c.prompt_points") > 0, points).alias("prompt_points"),
        "c.source_frame_idx",
        "c.timing.elapsed_seconds",
        "c.timing.num_frames",
    )


def prompt_points(chunks: DataFrame) -> DataFrame:
    """(video_id, chunk_idx, id, x, y) rows."""
    per = chunks.select("video_id", "chunk_idx", F.explode("prompt_points").alias("id", "pts"))
    one = per.select("video_id", "chunk_idx", "id", F.explode("pts").alias("p"))
    return one.select(
        "video_id", "chunk_idx", "id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")
    )


def _truthy(c: str) -> Column:
    return F.lower(F.trim(F.col(c))).isin("true", "1")


def manifest(spark: SparkSession, path: str, *, selected_only: bool = False) -> DataFrame:
    df = spark.read.option("header", "true").schema(schemas.MANIFEST).csv(path)
    df = df.withColumn("selected", _truthy("selected"))
    return df.filter("selected") if selected_only else df


def keyframes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schemas.KEYFRAMES).csv(path)


def mot_text(spark: SparkSession, root: str) -> DataFrame:
    """Headerless tracking text below <root>/<variant>/<video>.txt."""
    df = _below(spark, "*.txt").schema(schemas.MOT).csv(root)
    return df.select(
        path_part(1).alias("variant"),
        F.regexp_replace(path_part(0), r"\.txt$", "").alias("video_id"),
        F.col("frame").alias("frame_idx"),
        "id",
        "x",
        "y",
        "w",
        "h",
    )


def annotation_boxes(spark: SparkSession, root: str, *, name: str = "annotations.json") -> DataFrame:
    """Drawn boxes and their bookkeeping: one row per shape with ``kind`` drawn / outside.

    Ids are 1-based track positions; shapes other than rectangles are left out.
    """
    df = _below(spark, name).option("multiLine", "true").schema(schemas.ANNOTATION).json(root)
    t = df.select(path_part(1).alias("task"), F.posexplode("tracks").alias("pos", "t"))
    s = t.select("task", (F.col("pos") + 1).alias("id"), F.explode("t.shapes").alias("s"))
    outside = F.coalesce("s.outside", F.lit(False))
    p = [F.get("s.points", F.lit(i)) for i in range(4)]
    rows = s.withColumn("kind", F.when(outside, F.lit("outside")).otherwise(F.lit("drawn")))
    return rows.filter(outside | (F.col("s.type") == "rectangle")).select(
        "task",
        "id",
        F.col("s.frame").alias("frame_idx"),
        "kind",
        p[0].alias("x"),
        p[1].alias("y"),
        (p[2] - p[0]).alias("w"),
        (p[3] - p[1]).alias("h"),
    )


def annotation_counts(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy("task", "id").agg(
        F.count_if(F.col("kind") == "drawn").alias("drawn"), F.count_if(F.col("kind") == "outside").alias("outside")
    )


def label_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Wide label tables exported as CSV with a header; every value as text but the flags."""
    df = spark.read.option("header", "true").csv(path)
    fixed = ("sheet", "bird_description", "min", "sek")
    return df.select(*[F.col(c) if c in fixed else F.expr(f"try_cast(`{c}` AS int)").alias(c) for c in df.columns])


def flatten_frames(nested: DataFrame) -> DataFrame:
    """Nested per-frame outputs in any accepted shape to flat detections.

    Per frame: parallel arrays (object_ids, boxes, scores, score map), or an array of
    detection structs under ``detections`` or ``instances``.
    """
    cols = nested.columns
    keep = [c for c in ("video_id", "frame_idx") if c in cols]
    shape = "array<struct<id:int,bbox:array<double>,score:double,tracker_score:double>>"
    options = [F.col(c).cast(shape) for c in ("detections", "instances") if c in cols]
    if "object_ids" in cols:
        scores = F.col("scores") if "scores" in cols else F.lit(None).cast("array<double>")
        by_id = (
            F.col("obj_id_to_tracker_score")
            if "obj_id_to_tracker_score" in cols
            else F.lit(None).cast("map<string,double>")
        )
        zipped = F.transform(
            "object_ids",
            lambda oid, i: F.struct(
                oid.cast("int").alias("id"),
                F.get("boxes", i).alias("bbox"),
                F.when(scores.isNull(), F.lit(0.0)).otherwise(F.get(scores, i)).alias("score"),
                by_id[oid.cast("string")].alias("tracker_score"),
            ),
        )
        options.append(zipped.cast(shape))
    return nested.select(*keep, F.inline(F.coalesce(*options)))


def frame_points(tracks: DataFrame, frames: DataFrame, *, offsets: tuple[int, ...] = (0,)) -> DataFrame:
    """Rows of the frames ``frame_idx + offset`` around each wanted (video_id, frame_idx)."""
    wanted = frames.select("video_id", F.explode(F.array(*[F.col("frame_idx") + o for o in offsets])).alias("frame_idx"))
    return tracks.join(wanted.distinct(), ["video_id", "frame_idx"], "left_semi")

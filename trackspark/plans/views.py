"""Domain views over the relational tables (there is no tracking table to read).

Every view is a plain projection or aggregation of a whole table:

* ``detections`` from lineitem: the order key spells (video, frame), the line number is the
  track, price attributes give the box and scores;
* ``label_sheet`` / ``labels`` from orders; ``masks`` are rectangles over the detections;
* ``actions`` from orders: repair actions per video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.operators.labels import BEHAVIOURS

FPS = 25.0
WIDTH, HEIGHT = 640, 480


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def video_of(key: Column) -> Column:
    return F.concat(
        F.lit("C"),
        (key % 5 + 1).cast("string"),
        F.lit("G"),
        (F.floor(key / 5) % 3 + 1).cast("string"),
        F.lit("D"),
        (F.floor(key / 15) % 2 + 28).cast("string"),
    )


def frame_of(key: Column) -> Column:
    return F.floor(key / 30).cast("int")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.col("l_linenumber") * F.lit(60.0) + F.col("l_quantity")).alias("x1"),
        F.min(F.lit(100.0) + F.lit(200.0) * F.col("l_discount")).alias("y1"),
        F.max("l_tax").alias("tax"),
        F.min(F.lit(1.0) - F.col("l_discount")).alias("confidence"),
        F.min(F.lit(1.0) - F.lit(5.0) * F.col("l_tax")).alias("tracker_score"),
    )
    key = F.col("l_orderkey")
    return (
        g.withColumn("x2", F.col("x1") + F.lit(40.0) + F.lit(300.0) * F.col("tax"))
        .withColumn("y2", F.col("y1") + F.lit(50.0))
        .select(
            video_of(key).alias("video_id"),
            frame_of(key).alias("frame_idx"),
            F.col("l_linenumber").cast("int").alias("track_id"),
            "x1",
            "y1",
            "x2",
            "y2",
            ((F.col("x1") + F.col("x2")) / 2 / F.lit(float(WIDTH))).alias("cx_norm"),
            ((F.col("y1") + F.col("y2")) / 2 / F.lit(float(HEIGHT))).alias("cy_norm"),
            "confidence",
            "tracker_score",
        )
    )


#: Frames, and seconds, in a block of the registered queries: the small test tables span many blocks too.
BLOCK = 512
TIME_BLOCK = 20


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as raw tracking rows (tracking_id, bbox)."""
    return detections(spark, sf_dir).select(
        "video_id",
        "frame_idx",
        F.col("track_id").alias("tracking_id"),
        F.array("x1", "y1", "x2", "y2").alias("bbox"),
        "tracker_score",
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per video: fps and total frames."""
    o = table(spark, sf_dir, "orders")
    return (
        o.groupBy(video_of(F.col("o_orderkey")).alias("video_id"))
        .agg((F.max(frame_of(F.col("o_orderkey"))) + 1).alias("total_frames"))
        .withColumn("fps", F.lit(FPS))
    )


#: Which multi-hot column an order sets: (priority digit, status) -> behaviour; the last one never.
BEHAVIOUR_OF = dict(zip([(d, s) for d in "12345" for s in "OFP"][:13], BEHAVIOURS[:13], strict=True))


def label_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide label rows: one per (video, bird, second), 0/1 behaviour columns, no 'Worm pecking'."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    flags = [
        F.max(
            (
                (F.substring("o_orderpriority", 1, 1) == digit) & (F.col("o_orderstatus") == status)
            ).cast("int")
        ).alias(name)
        for (digit, status), name in BEHAVIOUR_OF.items()
    ]
    g = o.groupBy(
        video_of(key).alias("video_id"),
        (F.col("o_custkey") % 7 + 1).cast("int").alias("bird_id"),
        F.floor(frame_of(key) / 25).cast("int").alias("tick"),
    ).agg(*flags)
    sec = F.col("tick") + 1
    return g.select(
        F.concat_ws(" ", F.substring("video_id", 1, 4), F.col("bird_id")).alias("sheet"),
        F.substring("video_id", 6, 2).cast("int").alias("age"),
        "bird_id",
        F.concat(F.lit("bird "), F.col("bird_id")).alias("bird_description"),
        (F.floor(sec / 60) + 1).cast("string").alias("min"),
        (sec % 60).cast("string").alias("sek"),
        *BEHAVIOUR_OF.values(),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackspark.operators.labels import long_labels, resolve_dual_groups

    return resolve_dual_groups(long_labels(label_sheet(spark, sf_dir)))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair actions: trims from orders in status P, switches and matches per customer bucket."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    g = o.groupBy(video_of(key).alias("video_id"), F.floor(frame_of(key) / 100).alias("part")).agg(
        F.min(F.when(F.col("o_orderstatus") == "P", frame_of(key))).alias("f"),
        F.max((F.col("o_custkey") % 7 + 1).cast("int")).alias("hi"),
        F.min((F.col("o_custkey") % 5 + 1).cast("int")).alias("lo"),
        F.max_by((F.col("o_custkey") % 7 + 1).cast("int"), key).alias("any_id"),
    )
    trim = g.select(
        "video_id",
        F.lit("trim").alias("type"),
        F.lit(None).cast("int").alias("frame"),
        F.col("f").alias("from"),
        (F.col("f") + 9).alias("to"),
        F.when(F.col("part") % 2 == 0, F.col("any_id")).alias("id"),
        F.lit(None).cast("int").alias("protocol_id"),
        F.lit(None).cast("int").alias("tracking_id"),
        F.col("part").alias("seq"),
    )
    switch = g.select(
        "video_id",
        F.lit("id_switch").alias("type"),
        (F.col("f") + 5).alias("frame"),
        F.col("any_id").alias("from"),
        (F.col("any_id") % 7 + 1).alias("to"),
        F.lit(None).cast("int").alias("id"),
        F.lit(None).cast("int").alias("protocol_id"),
        F.lit(None).cast("int").alias("tracking_id"),
        F.col("part").alias("seq"),
    )
    return trim.unionByName(switch).filter(F.coalesce("frame", "from").isNotNull())


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with a rectangular run-length mask (``runs``) on a WIDTH x HEIGHT canvas."""
    d = detections(spark, sf_dir)
    x, y = F.floor("x1").cast("int"), F.floor("y1").cast("int")
    w = F.floor(F.col("x2") - F.col("x1")).cast("int")
    h = F.floor(F.col("y2") - F.col("y1")).cast("int")
    d = d.withColumns({"mx": x, "my": y, "mw": w, "mh": h})
    # Column-major runs: background up to the first pixel, then (h on, H - h off) per column.
    pairs = F.flatten(
        F.array_repeat(F.array(F.col("mh"), F.lit(HEIGHT) - F.col("mh")), F.col("mw") - 1)
    )
    tail = F.array(
        F.col("mh"), F.lit(WIDTH * HEIGHT) - (F.col("mx") + F.col("mw") - 1) * HEIGHT - F.col("my") - F.col("mh")
    )
    runs = F.concat(F.array(F.col("mx") * HEIGHT + F.col("my")), pairs, tail)
    return d.select(
        "video_id",
        F.col("track_id").alias("bird_id"),
        "frame_idx",
        F.array("x1", "y1", "x2", "y2").alias("bbox"),
        "tracker_score",
        runs.cast("array<int>").alias("runs"),
        F.array(F.lit(HEIGHT), F.lit(WIDTH)).alias("size"),
        "mx",
        "my",
        "mw",
        "mh",
    )

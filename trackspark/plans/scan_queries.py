"""Registered queries: scanning, crowding, periods (with their SQL twins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.operators import events, frames
from trackspark.plans import oracle as O
from trackspark.plans import views
from trackspark.session import cut_lineage

SEP = 0.10  # separation distance that suits the 640-pixel canvas
IOU = 0.07

FRAME_DOUBLES = [
    "min_centroid_distance",
    "mean_centroid_distance",
    "clustering_coefficient",
    "max_pairwise_bbox_iou",
    "mean_pairwise_bbox_iou",
    "mean_bbox_area",
    "min_bbox_area",
    "max_bbox_area",
    "bbox_area_variance",
    "mean_confidence",
    "separation_score",
]


AREAS = [c for c in FRAME_DOUBLES if "area" in c]
UNITS = [c for c in FRAME_DOUBLES if "area" not in c]


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round as the SQL twins do: a double is scaled and rounded as a double, not as its decimal text.

    0.053554687499999996 scaled by 1e9 is a tie and goes up; its decimal text would go down.
    """
    unit = 10.0**digits
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        if kinds[c] != "double":
            return F.round(F.col(c), digits)
        scaled = F.col(c) * F.lit(unit)
        return F.when(F.abs(scaled) < F.lit(float("inf")), F.round(scaled) / F.lit(unit)).otherwise(F.col(c))

    return df.withColumns({c: one(c) for c in cols})


def frame_metrics(spark: SparkSession, sf: str, *, changes: bool = True) -> DataFrame:
    stored = cut_lineage(views.detections(spark, sf), "detections")
    return frames.detection_frames(stored, iou_threshold=IOU, min_separation=SEP, changes=changes, block=views.BLOCK)


def q_frame_metrics(spark, sf):
    out = rounded(rounded(frame_metrics(spark, sf), *UNITS, digits=9), *AREAS, digits=4)
    return out.withColumn("objects_present", F.concat_ws(",", "objects_present"))


SQL_FRAMES = O.frames_cte(IOU, 0.15, SEP)

SQL_FRAME_METRICS = O.r6(
    O.r6(
    O._cte(*SQL_FRAMES)
    + "SELECT video_id, frame_idx, num_objects, num_overlapping_pairs, objects_present, is_high_occlusion, is_object_count_change, "
    + ", ".join(FRAME_DOUBLES)
    + " FROM fm",
    *UNITS,
    digits=9,
    ),
    *AREAS,
    digits=4,
)


def q_separation_windows(spark, sf):
    """Flagship: detections -> crowding metrics -> sustained separation windows."""
    return events.separation_windows(
        frame_metrics(spark, sf), min_frames=6, gap_frames=5, block=views.BLOCK
    )


SQL_SEPARATION = (
    O._cte(
        *SQL_FRAMES,
        ("good", "SELECT video_id, frame_idx FROM fm WHERE separation_score > 0"),
        ("runs", O.islands("good", "video_id", "frame_idx", "5")),
    )
    + """SELECT video_id, run_start AS start_frame, run_end AS end_frame, n_rows AS n_frames
    FROM runs WHERE run_end - run_start + 1 >= 6"""
)


def q_occlusion_periods(spark, sf):
    metrics = cut_lineage(
        frame_metrics(spark, sf).select("video_id", "frame_idx", "is_high_occlusion"), "frames"
    )
    return events.occlusion_periods(metrics, window_frames=10, threshold=0.9, block=views.BLOCK)


def q_occlusion_chain(spark, sf):
    """Flagged and other frames in turn: all periods of a video hang on the first one."""
    o = views.table(spark, sf, "orders")
    flag = (views.frame_of(F.col("o_orderkey")) % 4 < 2) | (F.col("o_custkey") % 7 == 0)
    rows = o.select(views.video_of(F.col("o_orderkey")).alias("video_id"), views.frame_of(F.col("o_orderkey")).alias("frame_idx"), flag.alias("is_high_occlusion"))
    return events.occlusion_periods(rows, window_frames=9, threshold=0.6, block=views.BLOCK)


# Next-pointer form of the scan: from each resume row, the first hot row opens a period that
# lasts to the first cold row after it; the search resumes a window later.
def _occlusion_sql(frames: list[tuple[str, str]], window: int, threshold: float) -> str:
    return (
        "WITH RECURSIVE "
        + O._cte(
            *frames,
            (
                "ix",
                f"""SELECT video_id, frame_idx, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n,
              avg(CASE WHEN is_high_occlusion THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY video_id ORDER BY frame_idx
                ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) >= {threshold} AS hot
              FROM fm WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)""",
            ),
            (
                "nx",
                """SELECT video_id, frame_idx, i, n,
              min(CASE WHEN hot THEN i END) OVER f AS next_hot, min(CASE WHEN NOT hot THEN i END) OVER f AS next_cold
              FROM ix WINDOW f AS (PARTITION BY video_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
            ),
            (
                "st",
                """SELECT a.video_id, a.i, a.n, a.next_hot AS s, coalesce(b.next_cold, a.n) AS e
              FROM nx a JOIN nx b ON a.video_id = b.video_id AND b.i = a.next_hot""",
            ),
            (
                "walk",
                f"""SELECT video_id, s, e, n FROM st WHERE i = 0
              UNION ALL SELECT st.video_id, st.s, st.e, st.n FROM walk JOIN st
                ON st.video_id = walk.video_id AND st.i = walk.e + {window}""",
            ),
        ).removeprefix("WITH ")
        + f"""SELECT w.video_id, p.frame_idx AS start_frame, q.frame_idx AS end_frame FROM walk w
        JOIN ix p ON p.video_id = w.video_id AND p.i = w.s
        JOIN ix q ON q.video_id = w.video_id AND q.i = least(w.e + {window - 1}, w.n - 1)"""
    )


SQL_OCCLUSION = _occlusion_sql(SQL_FRAMES, 10, 0.9)
SQL_OCCLUSION_CHAIN = _occlusion_sql(
    [
        (
            "fm",
            f"""SELECT {O.video('o_orderkey')} AS video_id, CAST(o_orderkey // 30 AS INTEGER) AS frame_idx,
          (o_orderkey // 30) % 4 < 2 OR o_custkey % 7 = 0 AS is_high_occlusion FROM orders""",
        )
    ],
    9,
    0.6,
)


def _fps(spark, sf):
    return views.videos(spark, sf)


def q_id_transitions(spark, sf):
    out = events.id_transitions(views.tracks(spark, sf), _fps(spark, sf), block=views.BLOCK)
    arrays = ["ids_before", "ids_after", "lost", "gained"]
    return out.withColumns({c: F.concat_ws(",", c) for c in arrays})


SQL_TRANSITIONS = (
    O._cte(
        O.DET,
        (
            "s",
            "SELECT video_id, frame_idx, list_sort(list(DISTINCT track_id)) AS ids FROM det GROUP BY ALL",
        ),
        (
            "p",
            "SELECT *, lag(ids) OVER (PARTITION BY video_id ORDER BY frame_idx) AS bef FROM s",
        ),
    )
    + """SELECT video_id, frame_idx, round(frame_idx / 25.0::DOUBLE, 2) AS time,
    array_to_string(bef, ',') AS ids_before, array_to_string(ids, ',') AS ids_after,
    array_to_string(list_filter(bef, lambda x: NOT list_contains(ids, x)), ',') AS lost,
    array_to_string(list_filter(ids, lambda x: NOT list_contains(bef, x)), ',') AS gained
    FROM p WHERE bef IS NOT NULL AND bef <> ids"""
)


def q_low_score(spark, sf):
    return events.low_score_periods(
        views.tracks(spark, sf),
        _fps(spark, sf),
        threshold=0.8,
        min_seconds=0.4,
        merge_gap_seconds=0.2,
        block=views.BLOCK,
    )


SQL_LOW_SCORE = (
    O._cte(
        O.DET,
        ("low", "SELECT video_id, track_id, frame_idx FROM det WHERE tracker_score < 0.8"),
        ("runs", O.islands("low", "video_id, track_id", "frame_idx", "5")),
        ("keep", "SELECT * FROM runs WHERE run_end - run_start + 1 >= 10"),
    )
    + """SELECT k.video_id, k.track_id AS id, run_start AS start, run_end AS "end",
    round(run_start / 25.0::DOUBLE, 2) AS start_time, round(run_end / 25.0::DOUBLE, 2) AS end_time,
    count(*) FILTER (WHERE tracker_score < 0.8) AS low_score_rows, count(*) AS total_rows,
    round(min(tracker_score), 3) AS min_score
    FROM keep k JOIN det d ON d.video_id = k.video_id AND d.track_id = k.track_id
      AND d.frame_idx BETWEEN run_start AND run_end GROUP BY ALL"""
)


def q_occlusion_switches(spark, sf):
    return events.occlusion_aware_switches(frame_metrics(spark, sf, changes=False), block=views.BLOCK)


SQL_OCC_SWITCH = (
    O._cte(
        *SQL_FRAMES,
        (
            "s",
            "SELECT video_id, frame_idx, list_sort(list(DISTINCT track_id)) AS ids FROM det GROUP BY ALL",
        ),
        (
            "p",
            """SELECT fm.video_id, fm.frame_idx, num_objects, ids, lag(ids) OVER w AS bef, lag(num_objects) OVER w AS pn,
          coalesce(max(is_high_occlusion) OVER (PARTITION BY fm.video_id ORDER BY fm.frame_idx
            ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), FALSE) AS occ
          FROM fm JOIN s USING (video_id, frame_idx)
          WINDOW w AS (PARTITION BY fm.video_id ORDER BY fm.frame_idx)""",
        ),
        (
            "z",
            """SELECT video_id, frame_idx, list_filter(bef, lambda x: NOT list_contains(ids, x)) AS lost,
          list_filter(ids, lambda x: NOT list_contains(bef, x)) AS gained
          FROM p WHERE pn = num_objects AND pn > 0 AND occ""",
        ),
    )
    + """SELECT video_id, frame_idx, unnest(lost) AS old_id, unnest(gained) AS new_id FROM z
    WHERE len(lost) > 0 AND len(lost) = len(gained)"""
)


def q_score_segments(spark, sf):
    out = events.score_segments(views.tracks(spark, sf), block=views.BLOCK).withColumnRenamed("tracking_id", "id")
    return rounded(out, "mean_score")


SQL_SEGMENTS = O.r6(
    O._cte(
        O.DET,
        ("runs", O.islands("det", "video_id, track_id", "frame_idx", "1", ", avg(tracker_score) AS m")),
    )
    + """SELECT video_id, track_id AS id, run_start AS start, run_end AS "end", m AS mean_score FROM runs""",
    "mean_score",
)

QUERIES = {
    "frame_metrics": (q_frame_metrics, SQL_FRAME_METRICS),
    "separation_windows": (q_separation_windows, SQL_SEPARATION),
    "occlusion_periods": (q_occlusion_periods, SQL_OCCLUSION),
    "occlusion_chain": (q_occlusion_chain, SQL_OCCLUSION_CHAIN),
    "id_transitions": (q_id_transitions, SQL_TRANSITIONS),
    "low_score_periods": (q_low_score, SQL_LOW_SCORE),
    "occlusion_aware_switches": (q_occlusion_switches, SQL_OCC_SWITCH),
    "score_segments": (q_score_segments, SQL_SEGMENTS),
}


# --- issues, template, streaming twins --------------------------------------------------


def q_stability_triggers(spark, sf):
    from trackspark.streaming.stability import stability_triggers

    m = frame_metrics(spark, sf).select(
        "video_id",
        F.floor(F.col("frame_idx") / 200).cast("int").alias("chunk_idx"),
        "frame_idx",
        F.col("max_pairwise_bbox_iou").alias("max_iou"),
        "num_objects",
    )
    return rounded(stability_triggers(m, limit=0.2, window=5, cooldown=20), "max_iou")


# Walk over the eligible rows with the two counters as state.
SQL_STABILITY = (
    "WITH RECURSIVE "
    + O._cte(
        *SQL_FRAMES,
        (
            "r",
            """SELECT video_id, frame_idx // 200 AS chunk_idx, frame_idx, max_pairwise_bbox_iou AS m,
          row_number() OVER (PARTITION BY video_id, frame_idx // 200 ORDER BY frame_idx) AS i,
          avg(max_pairwise_bbox_iou) OVER (PARTITION BY video_id, frame_idx // 200 ORDER BY frame_idx ROWS 4 PRECEDING) AS a
          FROM fm WHERE num_objects >= 2""",
        ),
        (
            "ok",
            "SELECT *, (m < 0.2 AND a < 0.2) AS calm FROM r",
        ),
        (
            "hit",
            """SELECT video_id, chunk_idx, min(i) AS i FROM ok WHERE calm AND i >= 5 GROUP BY ALL
          UNION ALL SELECT h.video_id, h.chunk_idx, (SELECT min(o.i) FROM ok o WHERE o.video_id = h.video_id
            AND o.chunk_idx = h.chunk_idx AND o.calm AND o.i >= h.i + 20) FROM hit h WHERE h.i IS NOT NULL""",
        ),
    ).removeprefix("WITH ")
    + """SELECT ok.video_id, CAST(ok.chunk_idx AS INTEGER) AS chunk_idx, ok.frame_idx, round(m, 6) AS max_iou
    FROM hit JOIN ok ON ok.video_id = hit.video_id AND ok.chunk_idx = hit.chunk_idx AND ok.i = hit.i"""
)


def q_action_template(spark, sf):
    from trackspark.operators import repair

    t, fps = views.tracks(spark, sf), _fps(spark, sf)
    empty = "video_id string, ids array<int>, start int, end int, start_time double, end_time double"
    issues = events.tracking_issues(
        spark.createDataFrame([], empty),
        events.id_transitions(t, fps, block=views.BLOCK),
        events.low_score_periods(t, fps, min_seconds=0.4, merge_gap_seconds=0.2, block=views.BLOCK),
    )
    birds = views.label_sheet(spark, sf).select(
        F.concat(F.substring("sheet", 1, 4), F.lit("D"), "age").alias("video_id"),
        F.col("bird_id").cast("string").alias("protocol_id"),
        F.col("bird_description").alias("description"),
    ).distinct()
    out = repair.action_template(issues, t, birds, fps)
    return out.select("video_id", "type", "frame", "from", "to", "id", "protocol_id", "_time").withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("frame", "from", "to", "id", "protocol_id", "_time")}
    )


_CLOCK = "printf('%02d:%05.2f', CAST(floor({f} / 25.0::DOUBLE / 60) AS INTEGER), {f} / 25.0::DOUBLE - 60 * floor({f} / 25.0::DOUBLE / 60))"
_T = SQL_TRANSITIONS.index("SELECT video_id, frame_idx, round(frame_idx / 25.0::DOUBLE, 2) AS time")
SQL_TEMPLATE = (
    SQL_TRANSITIONS[:_T]
    + ", low AS (SELECT video_id, track_id, frame_idx FROM det WHERE tracker_score < 0.8), runs AS ("
    + O.islands("low", "video_id, track_id", "frame_idx", "5")
    + """), tr AS (SELECT video_id, frame_idx, unnest(list_filter(ids, lambda x: NOT list_contains(bef, x))) AS g
      FROM p WHERE bef IS NOT NULL AND bef <> ids)
    SELECT video_id, 'trim' AS type, '-' AS frame, CAST(run_start AS VARCHAR) AS "from", CAST(run_end AS VARCHAR) AS "to",
      CAST(track_id AS VARCHAR) AS id, '-' AS protocol_id, """
    + _CLOCK.format(f="run_start")
    + " || '-' || "
    + _CLOCK.format(f="run_end")
    + """ AS _time FROM runs WHERE run_end - run_start + 1 >= 10
    UNION ALL SELECT video_id, 'id_switch', CAST(frame_idx AS VARCHAR), '-', CAST(g AS VARCHAR), '-', '-', """
    + _CLOCK.format(f="frame_idx")
    + f""" FROM tr
    UNION ALL SELECT DISTINCT {O.video('o_orderkey')}, 'id_match', '-', '-', '-', '-', CAST(1 + o_custkey % 7 AS VARCHAR), '-' FROM orders"""
)


def q_upsert_latest(spark, sf):
    """Keep-last upsert of two halves of the detections that overlap in their keys."""
    from trackspark.sources.writers import upsert

    d = views.detections(spark, sf).select("video_id", "frame_idx", "track_id", "confidence")
    old = d.withColumn("version", F.lit(0))
    new = d.select("video_id", "frame_idx", (F.col("track_id") % 7 + 1).alias("track_id"), "confidence", F.lit(1).alias("version"))
    return upsert(old, new, ["video_id", "frame_idx", "track_id"], "version")


SQL_UPSERT = (
    O._cte(
        O.DET,
        (
            "u",
            """SELECT video_id, frame_idx, track_id, confidence, 0 AS version FROM det
          UNION ALL SELECT video_id, frame_idx, track_id % 7 + 1, confidence, 1 FROM det""",
        ),
    )
    + "SELECT video_id, frame_idx, track_id, arg_max(confidence, version) AS confidence, max(version) AS version FROM u GROUP BY ALL"
)


def q_unique_keys(spark, sf):
    from trackspark.operators.joins import duplicate_keys

    li = views.table(spark, sf, "lineitem")
    return duplicate_keys(li, ["l_orderkey", "l_linenumber"])


SQL_DUPLICATES = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def q_key_difference(spark, sf):
    from trackspark.operators.joins import key_difference

    d = views.detections(spark, sf).select("video_id", "frame_idx")
    o = views.table(spark, sf, "orders")
    f = o.select(views.video_of(F.col("o_custkey")).alias("video_id"), views.frame_of(F.col("o_orderkey")).alias("frame_idx"))
    return key_difference(d, f, ["video_id", "frame_idx"])


SQL_KEY_DIFFERENCE = (
    O._cte(
        O.DET,
        ("a", "SELECT DISTINCT video_id, frame_idx FROM det"),
        ("b", f"SELECT DISTINCT {O.video('o_custkey')} AS video_id, CAST(o_orderkey // 30 AS INTEGER) AS frame_idx FROM orders"),
    )
    + """SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)

QUERIES |= {
    "stability_triggers": (q_stability_triggers, SQL_STABILITY),
    "action_template": (q_action_template, SQL_TEMPLATE),
    "upsert_latest": (q_upsert_latest, SQL_UPSERT),
    "duplicate_keys": (q_unique_keys, SQL_DUPLICATES),
    "key_difference": (q_key_difference, SQL_KEY_DIFFERENCE),
}

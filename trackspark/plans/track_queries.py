"""Registered queries: lifecycle metrics, chunking, keyframes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import chunks, events, lifecycle
from trackspark.plans import oracle as O
from trackspark.plans import scan_queries as S
from trackspark.plans import views
from trackspark.plans.scan_queries import rounded
from trackspark.session import cut_lineage

PRES = [
    O.DET,
    ("cnt", "SELECT video_id, frame_idx, count(*) AS n FROM det GROUP BY ALL"),
    (
        "prev",
        """SELECT d.*, n < 3 AS is_low, lag(frame_idx) OVER w AS pf, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1,
      lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM det d JOIN cnt USING (video_id, frame_idx)
      WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_idx)""",
    ),
    (
        "pres",
        f"""SELECT p.*, CASE WHEN pf IS NOT NULL THEN {O.iou('q', 'p')} END AS self_iou, frame_idx - pf - 1 AS gap,
      sum(CASE WHEN frame_idx = pf + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx) AS run
      FROM (SELECT *, {{'x1': px1, 'y1': py1, 'x2': px2, 'y2': py2}} AS q FROM prev) p""",
    ),
]
NEXT = [
    ("fs", "SELECT DISTINCT video_id, frame_idx FROM det"),
    ("fo", "SELECT *, lead(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS nf FROM fs"),
    (
        "np",
        f"""SELECT a.video_id, a.frame_idx, a.track_id AS ia, b.track_id AS ib, {O.iou('a', 'b')} AS iou
      FROM det a JOIN fo USING (video_id, frame_idx) JOIN det b ON b.video_id = a.video_id AND b.frame_idx = fo.nf""",
    ),
    ("np5", "SELECT * FROM np WHERE iou >= 0.5"),
]
ID_DOUBLES = ["coverage", "low_count_fraction", "self_iou", "mean_bbox_area", "spatial_continuity_iou"]
ID_SQL = [
    (
        "idm",
        """SELECT video_id, track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS length,
      CAST(max(run) AS BIGINT) AS runs, CAST(coalesce(sum(gap), 0) AS BIGINT) AS gaps_total,
      count(*) FILTER (WHERE is_low) AS low_count_total, avg(self_iou) AS self_iou,
      avg((x2 - x1) * (y2 - y1)) AS mean_bbox_area, CAST(max(frame_idx) - min(frame_idx) + 1 AS BIGINT) AS span,
      count(*) / (max(frame_idx) - min(frame_idx) + 1) AS coverage,
      count(*) FILTER (WHERE is_low) / (max(frame_idx) - min(frame_idx) + 1) AS low_count_fraction
      FROM pres GROUP BY ALL""",
    ),
    (
        "sci",
        """SELECT video_id, ia AS track_id, avg(m) AS spatial_continuity_iou FROM (
      SELECT video_id, frame_idx, ia, max(iou) AS m FROM np5 GROUP BY ALL) GROUP BY ALL""",
    ),
    ("idf", "SELECT idm.*, spatial_continuity_iou FROM idm LEFT JOIN sci USING (video_id, track_id)"),
]


def q_id_metrics(spark, sf):
    t = views.tracks(spark, sf)
    out = lifecycle.id_metrics(t, block=views.BLOCK)
    return rounded(out.withColumnRenamed("tracking_id", "id"), *ID_DOUBLES, digits=8)


SQL_ID_METRICS = O.r6(
    O._cte(*PRES, *NEXT, *ID_SQL) + "SELECT * EXCLUDE (track_id), track_id AS id FROM idf", *ID_DOUBLES, digits=8
)
RUN_DOUBLES = ["low_count_fraction", "mean_iou", "mean_bbox_area", "mean_tracker_score"]


def q_run_metrics(spark, sf):
    rows = lifecycle.presence(views.tracks(spark, sf), block=views.BLOCK)
    out = lifecycle.run_metrics(rows, block=views.BLOCK)
    return rounded(out.withColumnRenamed("tracking_id", "id"), *RUN_DOUBLES, digits=8)


SQL_RUN_METRICS = O.r6(
    O._cte(*PRES)
    + """SELECT video_id, track_id AS id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS length,
    count(*) FILTER (WHERE is_low) AS low_count_total, count(*) FILTER (WHERE is_low) / count(*) AS low_count_fraction,
    avg(CASE WHEN pf = frame_idx - 1 THEN self_iou END) AS mean_iou, avg((x2 - x1) * (y2 - y1)) AS mean_bbox_area,
    avg(tracker_score) AS mean_tracker_score, CAST(run - 1 AS BIGINT) AS run_idx
    FROM pres GROUP BY video_id, track_id, run""",
    *RUN_DOUBLES,
    digits=8,
)


def q_greedy_matches(spark, sf):
    out = lifecycle.greedy_matches(views.tracks(spark, sf), block=views.BLOCK)
    return rounded(out.withColumnRenamed("tracking_id", "id"), "iou", digits=8)


# Sequential fold over the overlapping pairs of a frame: best free partner for each id in turn.
GREEDY = [
    (
        "gl",
        """SELECT video_id, frame_idx, list({'a': ia, 'b': ib, 'o': iou, 'ok': FALSE, 'ua': [0], 'ub': [0]}
      ORDER BY ia, iou DESC, ib) AS c FROM np5 GROUP BY ALL""",
    ),
    (
        "gw",
        """SELECT video_id, frame_idx, c, 1 AS i, [c[1]] AS taken FROM gl
      UNION ALL SELECT video_id, frame_idx, c, i + 1,
        CASE WHEN len(list_filter(taken, lambda t: t.a = c[i + 1].a OR t.b = c[i + 1].b)) = 0
          THEN list_append(taken, c[i + 1]) ELSE taken END FROM gw WHERE i < len(c)""",
    ),
    (
        "gm",
        """SELECT video_id, frame_idx, t.a AS id, t.b AS next_id, t.o AS iou, t.a <> t.b AS is_switch
      FROM (SELECT video_id, frame_idx, unnest(taken) AS t FROM gw WHERE i = len(c))""",
    ),
]
SQL_GREEDY = O.r6(
    "WITH RECURSIVE "
    + O._cte(O.DET, *NEXT, *GREEDY).removeprefix("WITH ")
    + "SELECT video_id, frame_idx, id, next_id, iou, is_switch FROM gm",
    "iou",
    digits=8,
)
SUM_DOUBLES = [
    "mean_track_length",
    "persistence_rate",
    "mean_fragmentation_runs_per_id",
    "mean_coverage_per_id",
    "mean_per_id_iou",
    "avg_detections_per_frame",
    "continuity_fraction",
    "id_switch_rate",
    "low_frame_fraction",
]


def q_video_summary(spark, sf):
    out = lifecycle.video_summary(views.tracks(spark, sf), block=views.BLOCK)
    return rounded(out, *SUM_DOUBLES, digits=8)


SQL_VIDEO_SUMMARY = O.r6(
    "WITH RECURSIVE "
    + O._cte(
        *PRES,
        *NEXT,
        *ID_SQL,
        *GREEDY,
        (
            "pi",
            """SELECT video_id, count(*) AS total_unique_ids, avg(length) AS mean_track_length,
          avg(CASE WHEN length >= 5 THEN 1.0 ELSE 0.0 END) AS persistence_rate, avg(runs) AS mean_fragmentation_runs_per_id,
          avg(coverage) AS mean_coverage_per_id, avg(self_iou) AS mean_per_id_iou FROM idf GROUP BY ALL""",
        ),
        (
            "ff",
            """SELECT video_id, count(*) AS n_frames, avg(n) AS avg_detections_per_frame,
          count(*) FILTER (WHERE n < 3) AS low_frame_count, count(*) FILTER (WHERE n < 3) / count(*) AS low_frame_fraction
          FROM cnt GROUP BY ALL""",
        ),
        (
            "co",
            """SELECT d.video_id, count(*) FILTER (WHERE b.track_id IS NOT NULL) / count(*) AS continuity_fraction
          FROM det d JOIN fo USING (video_id, frame_idx) LEFT JOIN det b ON b.video_id = d.video_id
            AND b.frame_idx = fo.nf AND b.track_id = d.track_id WHERE nf IS NOT NULL GROUP BY ALL""",
        ),
        (
            "ma",
            """SELECT video_id, count(*) AS iou_match_count, count(*) FILTER (WHERE is_switch) AS id_switches,
          count(*) FILTER (WHERE is_switch) / count(*) AS id_switch_rate FROM gm GROUP BY ALL""",
        ),
    ).removeprefix("WITH ")
    + "SELECT * FROM ff JOIN pi USING (video_id) JOIN co USING (video_id) JOIN ma USING (video_id)",
    *SUM_DOUBLES,
    digits=8,
)

# --- chunking ---------------------------------------------------------------------------

VID = (
    "vid",
    f"""SELECT {O.video('o_orderkey')} AS video_id, CAST(max(o_orderkey // 30) + 1 AS BIGINT) AS total
    FROM orders GROUP BY ALL""",
)


def q_fixed_chunks(spark, sf):
    return chunks.fixed_chunks(views.videos(spark, sf), chunk_seconds=3.9)


FIXED = (
    "fixed",
    """SELECT video_id, CAST(i AS INTEGER) AS chunk_idx, i * c AS start,
    CASE WHEN i > 0 AND total - least((i + 1) * c, total) > 0 AND total - least((i + 1) * c, total) < c * 0.1
      THEN total ELSE least((i + 1) * c, total) END AS "end",
    CASE WHEN i = 0 THEN 'video' ELSE 'tracker' END AS model_type
    FROM (SELECT *, unnest(range(greatest(CAST(ceil(total / c) AS BIGINT), 1))) AS i FROM (
      SELECT video_id, total, CAST(floor(25.0 * {sec}) AS BIGINT) AS c FROM vid))
    WHERE NOT (i > 1 AND least((i + 1) * c, total) - i * c < c * 0.1)""",
)
SQL_FIXED = O._cte(VID, (FIXED[0], FIXED[1].format(sec=3.9))) + "SELECT * FROM fixed"


def q_adaptive_chunks(spark, sf):
    metrics = S.frame_metrics(spark, sf)
    return chunks.adaptive_chunks(
        metrics, views.videos(spark, sf), chunk_seconds=3.9, search_seconds=1.0, max_seconds=5.0
    )


ADAPT_SQL = [
    VID,
    (FIXED[0], FIXED[1].format(sec=3.9)),
    (
        "nb",
        """SELECT video_id, chunk_idx, start, max("end") OVER (PARTITION BY video_id) AS fin,
      coalesce(lead(start) OVER (PARTITION BY video_id ORDER BY chunk_idx), max("end") OVER (PARTITION BY video_id)) AS nx,
      count(*) OVER (PARTITION BY video_id) AS nc FROM fixed""",
    ),
    (
        "cand",
        """SELECT nb.video_id, chunk_idx, list({'f': frame_idx, 's': separation_score} ORDER BY separation_score DESC, frame_idx)
        FILTER (WHERE separation_score > 0 AND nx - frame_idx <= 125) AS sep,
      list({'f': frame_idx} ORDER BY max_pairwise_bbox_iou,
        CASE WHEN min_centroid_distance = 'inf'::DOUBLE THEN 0 ELSE -min_centroid_distance END, frame_idx)
        FILTER (WHERE num_objects >= 2 AND nx - frame_idx <= 125) AS fb
      FROM nb JOIN fm ON fm.video_id = nb.video_id AND frame_idx BETWEEN greatest(start - 25, 0) AND least(fin, start + 25)
      WHERE chunk_idx > 0 GROUP BY ALL""",
    ),
    (
        "walk",
        """SELECT video_id, chunk_idx, start AS pos, fin, nc FROM nb WHERE chunk_idx = 0
      UNION ALL SELECT video_id, chunk_idx, CASE WHEN b IS NOT NULL AND b <> start THEN b ELSE coalesce(fbk, start) END, fin, nc
      FROM (SELECT w.video_id, nb.chunk_idx, nb.start, w.fin, w.nc,
          list_filter(cand.sep, lambda s: s.f - w.pos <= 125)[1].f AS b,
          list_filter(cand.fb, lambda s: s.f - w.pos <= 125)[1].f AS fbk
        FROM walk w JOIN nb ON nb.video_id = w.video_id AND nb.chunk_idx = w.chunk_idx + 1
        LEFT JOIN cand ON cand.video_id = w.video_id AND cand.chunk_idx = w.chunk_idx + 1)""",
    ),
    (
        "adj",
        """SELECT *, coalesce(lead(pos) OVER (PARTITION BY video_id ORDER BY chunk_idx), fin) AS e FROM walk""",
    ),
    (
        "adapt",
        """SELECT a.video_id, a.chunk_idx, a.pos AS start, CASE WHEN t.video_id IS NOT NULL AND a.chunk_idx = a.nc - 2 THEN a.fin
        ELSE a.e END AS "end", CASE WHEN a.chunk_idx = 0 THEN 'video' ELSE 'tracker' END AS model_type
      FROM adj a LEFT JOIN (SELECT video_id FROM adj WHERE chunk_idx = nc - 1 AND nc > 1 AND fin - pos < 97 * 0.1) t USING (video_id)
      WHERE NOT (t.video_id IS NOT NULL AND a.chunk_idx = a.nc - 1)""",
    ),
]
SQL_ADAPTIVE = (
    "WITH RECURSIVE "
    + O._cte(*S.SQL_FRAMES, *ADAPT_SQL).removeprefix("WITH ")
    + "SELECT video_id, chunk_idx, start, \"end\", model_type FROM adapt"
)


def q_keyframes(spark, sf):
    """Boundaries + longest low-separation stretches + uniform backbone, by priority."""
    metrics = cut_lineage(S.frame_metrics(spark, sf, changes=False), "frames")
    v = views.videos(spark, sf)
    cuts = chunks.fixed_chunks(v, chunk_seconds=3.9)
    wins = events.separation_windows(metrics, min_frames=3, block=views.BLOCK)
    return chunks.keyframe_schedule(cuts, chunks.longest_periods(wins, 3).drop("rank"), v, uniform_seconds=1.0)


SQL_KEYFRAMES = (
    O._cte(
        *S.SQL_FRAMES,
        VID,
        (FIXED[0], FIXED[1].format(sec=3.9)),
        ("good", "SELECT video_id, frame_idx FROM fm WHERE separation_score > 0"),
        ("runs", O.islands("good", "video_id", "frame_idx", "5")),
        (
            "top",
            """SELECT video_id, run_start AS a, run_end AS b FROM (SELECT *, row_number() OVER (PARTITION BY video_id
          ORDER BY run_end - run_start DESC, run_start) AS r FROM runs WHERE run_end - run_start + 1 >= 3) WHERE r <= 3""",
        ),
        (
            "allf",
            """SELECT video_id, unnest([start - 5, start, start + 5]) AS f, 0 AS p FROM fixed WHERE chunk_idx > 0
          UNION ALL SELECT video_id, unnest([a - 3, a, (a + b) // 2, b, b + 3]), 1 FROM top
          UNION ALL SELECT video_id, unnest(range(0, total, 25)), 2 FROM vid""",
        ),
    )
    + """SELECT video_id, f AS frame_idx, ['chunk_guided', 'occlusion_bracketing', 'uniform'][min(p) + 1] AS source
    FROM allf JOIN vid USING (video_id) WHERE f >= 0 AND f < total GROUP BY video_id, f"""
)


def _grounding_frames(spark, sf):
    m = S.frame_metrics(spark, sf)
    c = 100
    return m.select(
        "video_id",
        F.floor(F.col("frame_idx") / c).cast("int").alias("chunk_idx"),
        (F.floor(F.col("frame_idx") / c) * c).cast("int").alias("chunk_start"),
        "frame_idx",
        "num_objects",
        F.col("max_pairwise_bbox_iou").alias("max_iou"),
        F.col("mean_confidence").alias("mean_score"),
    )


def _grounding_query(method: str, order: str):
    def run(spark, sf):
        # Scores are rounded first: equal means must tie whatever the summation order.
        g = _grounding_frames(spark, sf).withColumns(
            {"mean_score": F.round("mean_score", 9), "max_iou": F.round("max_iou", 9)}
        )
        return chunks.best_grounding_frame(g, method=method).select("video_id", "chunk_idx", "frame_idx", "num_objects")

    sql = (
        O._cte(
            *S.SQL_FRAMES,
            (
                "g",
                """SELECT video_id, frame_idx // 100 AS chunk_idx, frame_idx, num_objects,
              round(max_pairwise_bbox_iou, 9) AS max_iou, round(mean_confidence, 9) AS mean_score FROM fm WHERE num_objects >= 3""",
            ),
        )
        + f"""SELECT video_id, chunk_idx, frame_idx, num_objects FROM (SELECT *, row_number() OVER (
        PARTITION BY video_id, chunk_idx ORDER BY {order}, frame_idx) AS r FROM g) WHERE r = 1"""
    )
    return run, sql


def q_seed_frame(spark, sf):
    return chunks.seed_frame(S.frame_metrics(spark, sf))


SQL_SEED = (
    O._cte(*S.SQL_FRAMES)
    + """SELECT video_id, frame_idx, num_objects FROM (SELECT *, row_number() OVER (PARTITION BY video_id
    ORDER BY num_objects DESC, frame_idx) AS r FROM fm WHERE frame_idx < 125) WHERE r = 1"""
)


def q_carryover_frame(spark, sf):
    return chunks.carryover_frame(_grounding_frames(spark, sf), min_objects=4)


SQL_CARRY = (
    O._cte(*S.SQL_FRAMES)
    + """SELECT video_id, chunk_idx, max(frame_idx) AS frame_idx FROM (SELECT *, frame_idx // 100 AS chunk_idx,
    row_number() OVER (PARTITION BY video_id, frame_idx // 100 ORDER BY frame_idx DESC) AS r FROM fm)
    WHERE r <= 10 AND num_objects >= 4 GROUP BY ALL"""
)

def q_schedule_summary(spark, sf):
    return rounded(chunks.schedule_summary(q_keyframes(spark, sf)), "percent")


SQL_SCHEDULE_SUMMARY = O.r6(
    f"""WITH k AS ({SQL_KEYFRAMES}), n AS (SELECT video_id, source, count(*) AS n FROM k GROUP BY ALL)
    SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY video_id) AS percent FROM n""",
    "percent",
)


def q_schedule_gaps(spark, sf):
    """Scheduled keyframes against the frames that hold at least five objects."""
    k = cut_lineage(q_keyframes(spark, sf), "schedule")
    drawn = views.detections(spark, sf).groupBy("video_id", "frame_idx").count().filter("count >= 5")
    return chunks.schedule_gaps(k, drawn)


SQL_SCHEDULE_GAPS = f"""WITH k AS (SELECT video_id, frame_idx FROM ({SQL_KEYFRAMES})),
    {O.DET[0]}2 AS ({O.DET[1]}), d AS (SELECT video_id, frame_idx FROM det2 GROUP BY ALL HAVING count(*) >= 5),
    u AS (SELECT video_id, 'missing' AS s FROM (SELECT * FROM k EXCEPT SELECT * FROM d)
      UNION ALL SELECT video_id, 'extra' FROM (SELECT * FROM d EXCEPT SELECT * FROM k))
    SELECT video_id, count(*) FILTER (WHERE s = 'missing') AS missing, count(*) FILTER (WHERE s = 'extra') AS extra FROM u GROUP BY ALL"""


def q_chunk_boundaries(spark, sf):
    c = chunks.clip_chunks(chunks.fixed_chunks(views.videos(spark, sf), chunk_seconds=3.9), views.videos(spark, sf))
    return chunks.boundaries(c).select("video_id", "chunk_idx", "boundary_frame", "prev_chunk_end", "model_type")


SQL_BOUNDARIES = (
    O._cte(VID, (FIXED[0], FIXED[1].format(sec=3.9)))
    + """SELECT video_id, chunk_idx, start AS boundary_frame, start - 1 AS prev_chunk_end, model_type FROM fixed WHERE chunk_idx > 0"""
)


def q_entity_differences(spark, sf):
    """Tracked ids against the ids the orders name, per video."""
    from trackspark.operators.joins import entity_differences

    d = views.detections(spark, sf).select("video_id", (F.col("track_id") + F.when(F.col("tracker_score") < 0.7, 5).otherwise(0)).alias("bird_id"))
    o = views.label_sheet(spark, sf).select(
        F.concat(F.substring("sheet", 1, 4), F.lit("D"), "age").alias("video_id"), "bird_id"
    )
    out = entity_differences(d, o)
    return out.withColumns({c: F.array_join(c, ",") for c in ("missing", "extra")})


SQL_ENTITIES = (
    O._cte(
        O.DET,
        ("h", "SELECT DISTINCT video_id, track_id + CASE WHEN tracker_score < 0.7 THEN 5 ELSE 0 END AS b FROM det"),
        ("w", f"SELECT DISTINCT {O.video('o_orderkey')} AS video_id, CAST(1 + o_custkey % 7 AS INTEGER) AS b FROM orders"),
        ("m", "SELECT video_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS missing FROM (SELECT * FROM w EXCEPT SELECT * FROM h) GROUP BY ALL"),
        ("x", "SELECT video_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS extra FROM (SELECT * FROM h EXCEPT SELECT * FROM w) GROUP BY ALL"),
    )
    + "SELECT video_id, coalesce(missing, '') AS missing, coalesce(extra, '') AS extra FROM m FULL JOIN x USING (video_id)"
)

QUERIES = {
    "id_metrics": (q_id_metrics, SQL_ID_METRICS),
    "run_metrics": (q_run_metrics, SQL_RUN_METRICS),
    "greedy_matches": (q_greedy_matches, SQL_GREEDY),
    "video_summary": (q_video_summary, SQL_VIDEO_SUMMARY),
    "fixed_chunks": (q_fixed_chunks, SQL_FIXED),
    "adaptive_chunks": (q_adaptive_chunks, SQL_ADAPTIVE),
    "keyframe_schedule": (q_keyframes, SQL_KEYFRAMES),
    "schedule_summary": (q_schedule_summary, SQL_SCHEDULE_SUMMARY),
    "schedule_gaps": (q_schedule_gaps, SQL_SCHEDULE_GAPS),
    "chunk_boundaries": (q_chunk_boundaries, SQL_BOUNDARIES),
    "entity_differences": (q_entity_differences, SQL_ENTITIES),
    "grounding_min_occlusion": _grounding_query("min_occlusion", "max_iou"),
    "grounding_best_scores": _grounding_query("best_scores", "mean_score DESC"),
    "grounding_combined": _grounding_query("combined", "max_iou >= 0.10, mean_score DESC"),
    "seed_frame": (q_seed_frame, SQL_SEED),
    "carryover_frame": (q_carryover_frame, SQL_CARRY),
}

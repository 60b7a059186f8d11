"""Registered queries: labels, repair, windows, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.functions import boxes as bx
from trackspark.functions import stats
from trackspark.operators import features, labels, repair, windows
from trackspark.plans import oracle as O
from trackspark.plans import views
from trackspark.plans.scan_queries import rounded
from trackspark.session import cut_lineage

# --- labels -----------------------------------------------------------------------------

_FLAGS = ", ".join(
    f"max(CASE WHEN substr(o_orderpriority, 1, 1) = '{d}' AND o_orderstatus = '{s}' THEN 1 ELSE 0 END) AS \"{n}\""
    for (d, s), n in views.BEHAVIOUR_OF.items()
)
SHEET = (
    "sheet",
    f"""SELECT {O.video('o_orderkey')} AS video_id, CAST(1 + o_custkey % 7 AS INTEGER) AS bird_id,
    CAST((o_orderkey // 30) // 25 AS INTEGER) AS tick, {_FLAGS} FROM orders GROUP BY ALL""",
)
_BEHAV = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ', ')".format(
    ", ".join(f"CASE WHEN \"{n}\" = 1 THEN '{n}' END" for n in views.BEHAVIOUR_OF.values())
)
LAB = [
    SHEET,
    (
        "lab0",
        f"""SELECT video_id, bird_id, 'bird ' || bird_id AS bird_description,
      CAST(tick + 1 AS DOUBLE) AS time, coalesce(nullif({_BEHAV}, ''), 'none') AS behav FROM sheet""",
    ),
    (
        "lab1",
        """SELECT *, CASE WHEN behav = 'none' THEN 'none' ELSE coalesce(nullif(array_to_string(list_filter([
      CASE WHEN regexp_matches(behav, 'Running|Frolicking|Wing flapping|Spinning') THEN 'locomotor' END,
      CASE WHEN contains(behav, 'Sparring') THEN 'social' END,
      CASE WHEN contains(behav, 'Worm') THEN 'worm' END], lambda x: x IS NOT NULL), ', '), ''), 'other') END AS behav_group
      FROM lab0""",
    ),
    (
        "freq",
        "SELECT part, count(*) AS n FROM (SELECT unnest(string_split(behav_group, ', ')) AS part FROM lab1) GROUP BY part",
    ),
    (
        "labpart",
        """SELECT video_id, bird_id, time, unnest(string_split(behav_group, ', ')) AS part,
      generate_subscripts(string_split(behav_group, ', '), 1) AS pos FROM lab1""",
    ),
    (
        "pick",
        """SELECT video_id, bird_id, time, arg_min(part, n * 100 + pos) AS behav_label
      FROM labpart JOIN freq USING (part) GROUP BY ALL""",
    ),
    ("lab", "SELECT lab1.*, behav_label FROM lab1 JOIN pick USING (video_id, bird_id, time)"),
]


def q_labels(spark, sf):
    return views.labels(spark, sf)


SQL_LABELS = (
    O._cte(*LAB)
    + """SELECT video_id, bird_id, bird_description, time, behav, behav_group, behav_label,
    printf('%02d:%05.2f', CAST(floor(time / 60) AS INTEGER), time % 60) AS time_str FROM lab"""
)


def q_class_frequencies(spark, sf):
    return labels.class_frequencies(views.labels(spark, sf))


SQL_CLASS_FREQ = O._cte(*LAB) + "SELECT part, n FROM freq"


def q_bird_info(spark, sf):
    out = labels.bird_info(views.label_sheet(spark, sf))
    e = F.array_join(
        F.transform(F.map_entries("birds"), lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"])), ";"
    )
    return out.select("video_id", e.alias("birds"))


SQL_BIRD_INFO = (
    O._cte(*LAB)
    + """SELECT video_id, string_agg(bird_id || '=' || bird_description, ';' ORDER BY bird_id) AS birds
    FROM (SELECT DISTINCT video_id, bird_id, bird_description FROM lab) GROUP BY video_id"""
)


def q_collapse_rare(spark, sf):
    out = labels.collapse_rare(views.labels(spark, sf), min_count=40)
    return out.groupBy("behav_label", "behav_primary").agg(F.count("*").alias("n"))


SQL_COLLAPSE = (
    O._cte(
        *LAB,
        (
            "pr",
            """SELECT behav_label, CASE WHEN behav = 'none' THEN 'None'
        WHEN behav_label = 'worm' THEN coalesce(list_filter(string_split(behav, ', '), lambda x: starts_with(x, 'Worm'))[1], string_split(behav, ', ')[1])
        WHEN behav_label = 'social' THEN coalesce(list_filter(string_split(behav, ', '), lambda x: contains(x, 'Sparring'))[1], string_split(behav, ', ')[1])
        ELSE string_split(behav, ', ')[1] END AS p FROM lab""",
        ),
        ("cnt", "SELECT behav_label, p, count(*) AS c FROM pr GROUP BY ALL"),
    )
    + """SELECT behav_label, CASE WHEN c < 40 AND behav_label IN ('worm', 'locomotor', 'social')
    THEN 'Other ' || behav_label ELSE p END AS behav_primary, CAST(sum(c) AS BIGINT) AS n FROM cnt GROUP BY 1, 2"""
)

# --- repair -----------------------------------------------------------------------------

ACT = [
    (
        "act0",
        f"""SELECT {O.video('o_orderkey')} AS video_id, (o_orderkey // 30) // 100 AS part,
      min(CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey // 30 AS INTEGER) END) AS f,
      arg_max(CAST(1 + o_custkey % 7 AS INTEGER), o_orderkey) AS any_id FROM orders GROUP BY ALL""",
    ),
    (
        "cuts",
        """SELECT video_id, f AS a, f + 9 AS b, CASE WHEN part % 2 = 0 THEN any_id END AS id
      FROM act0 WHERE f IS NOT NULL""",
    ),
    (
        "sw",
        """SELECT video_id, f + 5 AS frame, any_id AS old, any_id % 7 + 1 AS new,
      row_number() OVER (PARTITION BY video_id ORDER BY f) AS ord FROM act0 WHERE f IS NOT NULL""",
    ),
]
TRIMMED = (
    "trimmed",
    """SELECT * FROM det d WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.video_id = d.video_id
    AND d.frame_idx BETWEEN c.a AND c.b AND (c.id IS NULL OR c.id = d.track_id))""",
)
LTRIMMED = (
    "ltrimmed",
    """SELECT * FROM lab l WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.video_id = l.video_id AND c.id IS NULL
    AND l.time BETWEEN c.a / 25.0::DOUBLE AND c.b / 25.0::DOUBLE)""",
)
# Switch walk: apply the switches of the video one by one, in frame order.
MERGED = (
    "merged",
    """SELECT t.*, list_reduce(list_prepend({'f': CAST(-1 AS INTEGER), 'o': track_id, 'n': track_id},
      coalesce(p.sws, [])), lambda acc, s: CASE WHEN t.frame_idx < s.f AND acc.n = s.o
        THEN {'f': s.f, 'o': s.o, 'n': s.n} ELSE {'f': s.f, 'o': s.o, 'n': acc.n} END).n AS bird_id
    FROM trimmed t LEFT JOIN (SELECT video_id, list({'f': frame, 'o': old, 'n': new} ORDER BY frame) AS sws
      FROM sw GROUP BY video_id) p USING (video_id)""",
)


def trimmed_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    return repair.trim(
        views.tracks(spark, sf),
        views.labels(spark, sf),
        views.actions(spark, sf),
        views.videos(spark, sf),
        block=views.BLOCK,
    )


def q_trim_tracks(spark, sf):
    t, _ = trimmed_tables(spark, sf)
    return t.groupBy("video_id", F.col("tracking_id").alias("id")).agg(
        F.count("*").alias("n"), F.min("frame_idx").alias("lo"), F.sum("frame_idx").alias("total")
    )


SQL_TRIM_TRACKS = (
    O._cte(O.DET, *ACT, TRIMMED)
    + """SELECT video_id, track_id AS id, count(*) AS n, min(frame_idx) AS lo, CAST(sum(frame_idx) AS BIGINT) AS total
    FROM trimmed GROUP BY ALL"""
)


def q_trim_labels(spark, sf):
    _, l = trimmed_tables(spark, sf)
    return l.select("video_id", "bird_id", "time", "behav_label")


SQL_TRIM_LABELS = (
    O._cte(*LAB, *ACT, LTRIMMED) + "SELECT video_id, bird_id, time, behav_label FROM ltrimmed"
)


def repaired(spark, sf) -> tuple[DataFrame, DataFrame]:
    acts = views.actions(spark, sf)
    t, l = trimmed_tables(spark, sf)
    return repair.merge_switches(t, acts, block=views.BLOCK).withColumnRenamed("tracking_id", "bird_id"), l


def q_merge_switches(spark, sf):
    t, _ = repaired(spark, sf)
    return t.select("video_id", "frame_idx", "bird_id", F.round(F.get("bbox", F.lit(0)), 6).alias("x1"))


SQL_MERGE = O.r6(
    O._cte(O.DET, *ACT, TRIMMED, MERGED) + "SELECT video_id, frame_idx, bird_id, x1 FROM merged", "x1"
)


# Matches in reverse id order, so that renames chain: 7 -> 107, 6 -> 7, ...
def _matches(spark, sf) -> DataFrame:
    o = views.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    g = o.groupBy(views.video_of(key).alias("video_id"), (F.col("o_custkey") % 7 + 1).cast("int").alias("tid")).agg(
        F.min(views.frame_of(key)).alias("frame")
    )
    return g.select(
        "video_id",
        F.lit("id_match").alias("type"),
        "frame",
        F.col("tid").alias("tracking_id"),
        (F.col("tid") + 1).alias("protocol_id"),
        (-F.col("tid")).alias("seq"),
    )


def q_match_ids(spark, sf):
    t = repair.match_ids(views.tracks(spark, sf), _matches(spark, sf))
    return t.groupBy("video_id", "bird_id").agg(F.count("*").alias("n"), F.min("frame_idx").alias("lo"))


# With descending ids no rename can feed a later one, so every match sees original ids.
SQL_MATCH = (
    O._cte(
        O.DET,
        (
            "m",
            f"""SELECT {O.video('o_orderkey')} AS video_id, CAST(1 + o_custkey % 7 AS INTEGER) AS tid,
          min(CAST(o_orderkey // 30 AS INTEGER)) AS frame FROM orders GROUP BY ALL""",
        ),
        (
            "ok",
            """SELECT DISTINCT m.video_id, m.tid FROM m JOIN det d ON d.video_id = m.video_id
          AND d.frame_idx = m.frame AND d.track_id = m.tid""",
        ),
    )
    + """SELECT d.video_id, CASE WHEN ok.tid IS NULL THEN d.track_id ELSE d.track_id + 1 END AS bird_id,
    count(*) AS n, min(frame_idx) AS lo FROM det d LEFT JOIN ok ON ok.video_id = d.video_id AND ok.tid = d.track_id
    GROUP BY ALL"""
)

# --- windows ----------------------------------------------------------------------------

BIRDS = (
    "birds",
    "SELECT video_id, bird_id, frame_idx, x1, y1, x2, y2, tracker_score FROM merged",
)
WIN = [
    O.DET,
    *LAB,
    *ACT,
    TRIMMED,
    LTRIMMED,
    MERGED,
    BIRDS,
    (
        "rng",
        """SELECT video_id, bird_id, min(frame_idx) / 25.0::DOUBLE AS t0, max(frame_idx) / 25.0::DOUBLE AS t1
      FROM birds GROUP BY ALL""",
    ),
    (
        "alab",
        "SELECT l.* FROM ltrimmed l JOIN rng r USING (video_id, bird_id) WHERE l.time BETWEEN t0 AND t1",
    ),
    (
        "wlab",
        """SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS "window", lag(time) OVER w AS pt
      FROM alab WINDOW w AS (PARTITION BY video_id, bird_id ORDER BY time)""",
    ),
    (
        "wtr",
        """SELECT b.*, l."window" FROM birds b JOIN wlab l ON l.video_id = b.video_id AND l.bird_id = b.bird_id
      AND b.frame_idx / 25.0::DOUBLE <= l.time AND (l.pt IS NULL OR b.frame_idx / 25.0::DOUBLE > l.pt)""",
    ),
    ("sp", "SELECT median(time - pt) AS spacing FROM wlab WHERE pt IS NOT NULL"),
    (
        "cov",
        """SELECT video_id, bird_id, "window", count(*) AS n_frames, any_value(spacing) AS spacing, count(*) / (any_value(spacing) * 25.0::DOUBLE) AS coverage
      FROM wtr CROSS JOIN sp GROUP BY ALL""",
    ),
    ("keep", "SELECT video_id, bird_id, \"window\" FROM cov WHERE spacing IS NULL OR coverage BETWEEN 0.3 AND 1.02"),
    ("ktr", "SELECT wtr.* FROM wtr SEMI JOIN keep USING (video_id, bird_id, \"window\")"),
    (
        "klab",  # without any spacing nothing is filtered
        """SELECT wlab.* FROM wlab CROSS JOIN sp LEFT JOIN keep USING (video_id, bird_id, "window")
      WHERE keep.video_id IS NOT NULL OR sp.spacing IS NULL""",
    ),
]


def aligned(spark, sf):
    t, l = repaired(spark, sf)
    t = cut_lineage(t, "repaired")
    fps = views.videos(spark, sf)
    return t, windows.align_labels(t, l, fps), fps


def windowed(spark, sf):
    t, l, fps = aligned(spark, sf)
    t, l = windows.assign_windows(t, cut_lineage(l, "labels"), fps, block=views.TIME_BLOCK)
    return cut_lineage(t, "windowed"), l, fps


def q_align_labels(spark, sf):
    _, l, _ = aligned(spark, sf)
    return l.select("video_id", "bird_id", "time", "behav_label")


SQL_ALIGN = O._cte(*WIN) + "SELECT video_id, bird_id, time, behav_label FROM alab"


def q_assign_windows(spark, sf):
    t, _, _ = windowed(spark, sf)
    return t.select("video_id", "bird_id", "frame_idx", "window")


SQL_ASSIGN = O._cte(*WIN) + 'SELECT video_id, bird_id, frame_idx, "window" FROM wtr'


def q_window_coverage(spark, sf):
    t, l, fps = windowed(spark, sf)
    out = windows.window_coverage(t, l, fps, block=views.TIME_BLOCK)
    return rounded(out, "coverage", "spacing")


SQL_COVERAGE = O.r6(O._cte(*WIN) + "SELECT * FROM cov", "coverage", "spacing")


def complete(spark, sf):
    t, l, fps = windowed(spark, sf)
    return windows.filter_incomplete(t, l, fps, min_coverage=0.3, block=views.TIME_BLOCK)


def q_complete_labels(spark, sf):
    _, l = complete(spark, sf)
    return l.select("video_id", "bird_id", "window", "time", "behav_label")


SQL_COMPLETE = O._cte(*WIN) + 'SELECT video_id, bird_id, "window", time, behav_label FROM klab'

# --- features ---------------------------------------------------------------------------

BOX_FEATURES = [
    "mask_area",
    "aspect_ratio",
    "velocity",
    "acceleration",
    "area_change_rate",
    "turning_angle",
    "velocity_autocorr",
    "min_dist_to_other",
    "mean_dist_to_other",
    "dist_change_rate",
]


def box_spatial(tracks: DataFrame) -> DataFrame:
    """Spatial features read off the box: the box stands in for a rectangular mask."""
    b = bx.box_from_array("bbox")
    keep = [c for c in ("window",) if c in tracks.columns]
    return tracks.select(
        "video_id",
        "bird_id",
        "frame_idx",
        *keep,
        bx.area(b).alias("mask_area"),
        bx.aspect_ratio(b).alias("aspect_ratio"),
        bx.centre_x(b).alias("centroid_x"),
        bx.centre_y(b).alias("centroid_y"),
    )


def frame_table(spark, sf) -> DataFrame:
    t, _ = complete(spark, sf)
    return features.frame_features(box_spatial(t), block=views.BLOCK)


SPAT = (
    "spat",
    """SELECT video_id, bird_id, frame_idx, "window", greatest((x2 - x1) * (y2 - y1), 0) AS mask_area,
    CASE WHEN y2 > y1 THEN (x2 - x1) / (y2 - y1) END AS aspect_ratio, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM ktr""",
)
FEAT = [
    *WIN,
    SPAT,
    (
        "nn",
        """SELECT a.video_id, a.bird_id, a.frame_idx, a.cx, a.cy, min(d) AS min_dist_to_other, avg(d) AS mean_dist_to_other,
      arg_min(b_id, d * 1000 + b_id / 1000000.0) AS nearest_neighbor_id
      FROM (SELECT a.video_id, a.bird_id, a.frame_idx, a.cx, a.cy, b.bird_id AS b_id,
        sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d
        FROM (SELECT DISTINCT video_id, bird_id, frame_idx, cx, cy FROM spat) a JOIN spat b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.bird_id <> b.bird_id) a
      GROUP BY ALL""",
    ),
    (
        "mv",
        """SELECT s.*, min_dist_to_other, mean_dist_to_other, nearest_neighbor_id,
      cx - lag(cx) OVER w AS vx, cy - lag(cy) OVER w AS vy, lag(mask_area) OVER w AS pa,
      lag(cx) OVER w - lag(cx, 2) OVER w AS ux, lag(cy) OVER w - lag(cy, 2) OVER w AS uy,
      min_dist_to_other - lag(min_dist_to_other) OVER w AS dist_change_rate
      FROM spat s LEFT JOIN nn USING (video_id, bird_id, frame_idx, cx, cy)
      WINDOW w AS (PARTITION BY video_id, bird_id ORDER BY frame_idx, cx, cy, mask_area)""",
    ),
    ("mv2", "SELECT *, sqrt(vx * vx + vy * vy) AS velocity, sqrt(ux * ux + uy * uy) AS v0 FROM mv"),
    (
        "feat",
        """SELECT *, velocity - v0 AS acceleration, velocity * v0 AS velocity_autocorr,
      CASE WHEN pa > 0 THEN (mask_area - pa) / pa END AS area_change_rate,
      CASE WHEN velocity >= 1 AND v0 >= 1 THEN abs(atan2(ux * vy - uy * vx, ux * vx + uy * vy)) END AS turning_angle
      FROM mv2""",
    ),
]


def q_frame_features(spark, sf):
    out = frame_table(spark, sf).drop("centroid_x", "centroid_y")
    out = out.withColumn("nearest_neighbor_id", F.coalesce("nearest_neighbor_id", F.lit(-1)))
    return rounded(out, *BOX_FEATURES)


SQL_FRAME_FEATURES = O.r6(
    O._cte(*FEAT)
    + 'SELECT video_id, bird_id, frame_idx, "window", coalesce(nearest_neighbor_id, -1) AS nearest_neighbor_id, '
    + ", ".join(BOX_FEATURES)
    + " FROM feat",
    *BOX_FEATURES,
)


def q_window_summary(spark, sf):
    out = features.summarise(frame_table(spark, sf), names=BOX_FEATURES)
    # A mean that cancels to rounding noise makes the ratio meaningless on either side.
    out = out.withColumns(
        {f"{c}_cv": F.when(F.abs(F.col(f"{c}_mean")) > 1e-9, F.col(f"{c}_cv")) for c in BOX_FEATURES}
    )
    return rounded(out, *[c for c in out.columns if c not in ("video_id", "bird_id", "window", "n_frames")], digits=8)


def _summary_sql(c: str) -> str:
    constant = f"min({c}) = max({c})"
    return f"""avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, median({c}) AS {c}_median, mad({c}) AS {c}_mad,
    CASE WHEN count({c}) >= 3 THEN CASE WHEN {constant} THEN 0.0 ELSE skewness({c}) END END AS {c}_skew,
    CASE WHEN count({c}) >= 4 THEN CASE WHEN {constant} THEN 0.0 ELSE kurtosis({c}) END END AS {c}_kurt,
    CASE WHEN abs(avg({c})) > 1e-9 THEN stddev_samp({c}) / avg({c}) END AS {c}_cv,
    quantile_cont({c}, 0.1) AS {c}_q10, quantile_cont({c}, 0.9) AS {c}_q90"""


_STATS = ["mean", "std", "median", "mad", "skew", "kurt", "cv", "q10", "q90"]
SQL_SUMMARY = O.r6(
    O._cte(*FEAT)
    + 'SELECT video_id, bird_id, "window", count(*) AS n_frames, '
    + ", ".join(_summary_sql(c) for c in BOX_FEATURES)
    + " FROM feat GROUP BY ALL",
    *[f"{c}_{s}" for c in BOX_FEATURES for s in _STATS],
    digits=8,
)


def q_window_sequences(spark, sf):
    out = features.window_sequences(frame_table(spark, sf), names=["mask_area", "aspect_ratio"])
    text = F.array_join(
        F.transform("seq", lambda v: F.round(F.get(v, F.lit(0)).cast("double"), 0).cast("long").cast("string")), ","
    )
    return out.select("video_id", "bird_id", "window", F.size("seq").cast("long").alias("steps"), text.alias("areas"))


SQL_SEQUENCES = (
    O._cte(*FEAT)
    + """SELECT video_id, bird_id, "window", count(*) AS steps,
    string_agg(CAST(CAST(round(CAST(CAST(mask_area AS FLOAT) AS DOUBLE), 0) AS BIGINT) AS VARCHAR), ',' ORDER BY frame_idx, CAST(mask_area AS FLOAT), CAST(aspect_ratio AS FLOAT)) AS areas
    FROM feat GROUP BY ALL"""
)

QUERIES = {
    "labels_long": (q_labels, SQL_LABELS),
    "class_frequencies": (q_class_frequencies, SQL_CLASS_FREQ),
    "bird_info": (q_bird_info, SQL_BIRD_INFO),
    "collapse_rare_behaviours": (q_collapse_rare, SQL_COLLAPSE),
    "trim_tracks": (q_trim_tracks, SQL_TRIM_TRACKS),
    "trim_labels": (q_trim_labels, SQL_TRIM_LABELS),
    "merge_id_switches": (q_merge_switches, SQL_MERGE),
    "match_ids": (q_match_ids, SQL_MATCH),
    "align_labels": (q_align_labels, SQL_ALIGN),
    "assign_windows": (q_assign_windows, SQL_ASSIGN),
    "window_coverage": (q_window_coverage, SQL_COVERAGE),
    "complete_window_labels": (q_complete_labels, SQL_COMPLETE),
    "frame_features": (q_frame_features, SQL_FRAME_FEATURES),
    "window_summary": (q_window_summary, SQL_SUMMARY),
    "window_sequences": (q_window_sequences, SQL_SEQUENCES),
}

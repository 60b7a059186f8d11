"""Registered queries: run-length masks (rectangles over the detections, closed-form twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import rle
from trackspark.operators import events, features, masks
from trackspark.plans import dataset_queries as D
from trackspark.plans import oracle as O
from trackspark.plans import views
from trackspark.plans.scan_queries import rounded

MASK = (
    "mk",
    """SELECT video_id, frame_idx, track_id AS id, CAST(floor(x1) AS BIGINT) AS mx, CAST(floor(y1) AS BIGINT) AS my,
    CAST(floor(x2 - x1) AS BIGINT) AS mw, CAST(floor(y2 - y1) AS BIGINT) AS mh FROM det""",
)
MPAIR = (
    "mp",
    """SELECT a.video_id, a.frame_idx, a.id AS id_a, b.id AS id_b,
    greatest(least(a.mx + a.mw, b.mx + b.mw) - greatest(a.mx, b.mx), 0)
      * greatest(least(a.my + a.mh, b.my + b.mh) - greatest(a.my, b.my), 0) AS inter,
    a.mw * a.mh + b.mw * b.mh AS total,
    sqrt(((a.mx + (a.mw - 1) / 2) - (b.mx + (b.mw - 1) / 2)) ** 2 + ((a.my + (a.mh - 1) / 2) - (b.my + (b.mh - 1) / 2)) ** 2) AS dist
    FROM mk a JOIN mk b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.id < b.id""",
)
MIOU = ("mi", "SELECT *, inter / (total - inter) AS iou FROM mp")


def coded(spark, sf):
    """The mask view in its stored form: compressed strings, of which no run is listed on the way."""
    m = views.masks(spark, sf)
    return m.withColumn("counts", rle.rectangle_codes(views.HEIGHT, views.WIDTH)("mx", "my", "mw", "mh"))


def q_round_trip(spark, sf):
    """Encode and decode every mask; the runs must come back."""
    m = views.masks(spark, sf).withColumn("counts", rle.rle_encode("runs")).withColumn("back", rle.rle_decode("counts"))
    return m.groupBy("video_id").agg(
        F.count("*").alias("n_masks"),
        F.count_if(F.col("back") == F.col("runs")).alias("n_same"),
        F.sum(F.size("back")).alias("n_runs"),
    )


SQL_ROUND_TRIP = (
    O._cte(O.DET, MASK)
    + """SELECT video_id, count(*) AS n_masks, count(*) AS n_same, CAST(sum(2 * mw + 1) AS BIGINT) AS n_runs
    FROM mk GROUP BY ALL"""
)
SHAPE = [
    "mask_area",
    "centroid_x",
    "centroid_y",
    "elongation",
    "orientation",
    "solidity",
    "eccentricity",
]


def q_mask_geometry(spark, sf):
    out = masks.spatial_features(coded(spark, sf)).drop("bbox_area", "aspect_ratio")
    # A square has no major axis: its angle is rounding noise.
    flat = F.when(F.col("elongation") < 1 + 1e-9, F.lit(0.0)).otherwise(F.abs("orientation"))
    return rounded(out.withColumn("orientation", flat), *SHAPE, digits=7)


# A w x h rectangle of pixels: variances (w^2-1)/12 and (h^2-1)/12, hull on pixel centres.
SQL_GEOMETRY = O.r6(
    O._cte(O.DET, MASK)
    + """SELECT video_id, id AS bird_id, frame_idx, CAST(mw * mh AS DOUBLE) AS mask_area, mx + (mw - 1) / 2 AS centroid_x,
    my + (mh - 1) / 2 AS centroid_y,
    sqrt((greatest(mw, mh) ** 2 - 1) / (least(mw, mh) ** 2 - 1)) AS elongation,
    CASE WHEN mw >= mh THEN 0.0::DOUBLE ELSE pi() / 2 END AS orientation,
    mw * mh / ((mw - 1) * (mh - 1)) AS solidity,
    sqrt(1 - (least(mw, mh) ** 2 - 1) / (greatest(mw, mh) ** 2 - 1)) AS eccentricity FROM mk""",
    *SHAPE,
    digits=7,
)


def q_mask_boxes(spark, sf):
    out = masks.mask_boxes(coded(spark, sf))
    return out.select("video_id", F.col("bird_id").alias("id"), "frame_idx", F.array_join("mask_box", ",").alias("box"))


SQL_BOXES = (
    O._cte(O.DET, MASK)
    + """SELECT video_id, id, frame_idx, mx || ',' || my || ',' || (mx + mw - 1) || ',' || (my + mh - 1) AS box FROM mk"""
)


def q_mask_overlaps(spark, sf):
    return rounded(masks.mask_overlaps(coded(spark, sf), entity="bird_id", threshold=0.05), "iou", digits=9)


SQL_OVERLAPS = O.r6(
    O._cte(O.DET, MASK, MPAIR, MIOU) + "SELECT video_id, frame_idx, id_a, id_b, iou FROM mi WHERE iou >= 0.05",
    "iou",
    digits=9,
)


def q_overlap_periods(spark, sf):
    ov = masks.mask_overlaps(coded(spark, sf), entity="bird_id", threshold=0.3)
    ov = ov.withColumn("fps", F.lit(views.FPS))
    out = events.overlap_periods(ov, block=views.BLOCK)
    return out.withColumn("ids", F.array_join("ids", ","))


SQL_OVERLAP_PERIODS = (
    O._cte(
        O.DET,
        MASK,
        MPAIR,
        MIOU,
        ("ov", "SELECT * FROM mi WHERE iou >= 0.3"),
        ("runs", O.islands("ov", "video_id, id_a, id_b", "frame_idx", "25")),
    )
    + """SELECT video_id, id_a || ',' || id_b AS ids, run_start AS start, run_end AS "end",
    round(run_start / 25.0::DOUBLE, 2) AS start_time, round(run_end / 25.0::DOUBLE, 2) AS end_time FROM runs"""
)
FRAME_COLS = [
    "min_centroid_distance",
    "mean_centroid_distance",
    "clustering_coefficient",
    "max_pairwise_mask_iou",
    "mean_pairwise_mask_iou",
    "mean_mask_area",
    "min_mask_area",
    "max_mask_area",
    "mask_area_variance",
]


def q_mask_frames(spark, sf):
    out = masks.mask_frames(coded(spark, sf), entity="bird_id", block=views.BLOCK)
    out = out.withColumn("objects_present", F.array_join("objects_present", ","))
    return rounded(out, *FRAME_COLS, digits=7)


SQL_MASK_FRAMES = O.r6(
    O._cte(
        O.DET,
        MASK,
        MPAIR,
        MIOU,
        (
            "o",
            """SELECT video_id, frame_idx, count(*) AS num_objects, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS objects_present,
          avg(mw * mh) AS mean_mask_area, CAST(min(mw * mh) AS DOUBLE) AS min_mask_area,
          CAST(max(mw * mh) AS DOUBLE) AS max_mask_area, var_pop(mw * mh) AS mask_area_variance FROM mk GROUP BY ALL""",
        ),
        (
            "p",
            """SELECT video_id, frame_idx, min(dist) AS mn, avg(dist) AS me, avg(CASE WHEN dist < 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cc,
          max(iou) AS mi, avg(iou) AS ai, count(*) FILTER (WHERE iou > 0.15) AS no FROM mi GROUP BY ALL""",
        ),
        (
            "f",
            """SELECT o.*, coalesce(mn, 'inf'::DOUBLE) AS min_centroid_distance, coalesce(me, 'inf'::DOUBLE) AS mean_centroid_distance,
          coalesce(cc, 0) AS clustering_coefficient, coalesce(mi, 0) AS max_pairwise_mask_iou,
          coalesce(ai, 0) AS mean_pairwise_mask_iou, coalesce(no, 0) AS num_overlapping_pairs
          FROM o LEFT JOIN p USING (video_id, frame_idx)""",
        ),
    )
    + """SELECT *, (max_pairwise_mask_iou > 0.15 OR clustering_coefficient > 0.5) AS is_high_occlusion,
    coalesce(lag(num_objects) OVER (PARTITION BY video_id ORDER BY frame_idx) <> num_objects, FALSE) AS is_object_count_change FROM f""",
    *FRAME_COLS,
    digits=7,
)


def q_spread_points(spark, sf):
    out = coded(spark, sf).withColumn("pts", rle.spread_points(3)("counts", masks.height()))
    text = F.array_join(F.transform("pts", lambda p: F.array_join(p, ":")), ";")
    return out.select("video_id", F.col("bird_id").alias("id"), "frame_idx", text.alias("points"))


SQL_POINTS = (
    O._cte(O.DET, MASK, ("r", "SELECT *, unnest([0, (mw * mh - 1) // 2, mw * mh - 1]) AS rk FROM mk"))
    + """SELECT video_id, id, frame_idx, string_agg((mx + rk // mh) || ':' || (my + rk % mh), ';' ORDER BY rk) AS points
    FROM r GROUP BY ALL"""
)


def q_body_thirds(spark, sf):
    out = coded(spark, sf).withColumn("t", rle.body_thirds("counts", masks.height()))
    return out.groupBy("video_id").agg(
        F.count("t").alias("n"), F.sum(F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x)).alias("pixels")
    )


SQL_THIRDS = (
    O._cte(O.DET, MASK)
    + "SELECT video_id, count(*) AS n, CAST(sum(mw * mh) AS BIGINT) AS pixels FROM mk GROUP BY ALL"
)


def q_chunk_id_matching(spark, sf):
    """Match the ids of each chunk's first frame to those of the frame before it, by box overlap."""
    from trackspark.functions import boxes as bx

    d = views.detections(spark, sf).select("video_id", "frame_idx", "track_id", bx.box().alias("box"))
    c = F.floor(F.col("frame_idx") / 20).cast("int")
    per_chunk = d.groupBy("video_id", c.alias("chunk_idx")).agg(
        F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last")
    )
    first = d.join(
        per_chunk.select("video_id", "chunk_idx", F.col("first").alias("frame_idx")), ["video_id", "frame_idx"]
    ).select("video_id", "chunk_idx", F.col("track_id").alias("new_id"), F.col("box").alias("nb"))
    last = d.join(
        per_chunk.select("video_id", (F.col("chunk_idx") + 1).alias("chunk_idx"), F.col("last").alias("frame_idx")),
        ["video_id", "frame_idx"],
    ).select("video_id", "chunk_idx", (F.col("track_id") % 7 + 1).alias("prev_id"), F.col("box").alias("pb"))
    pairs = first.join(last, ["video_id", "chunk_idx"]).withColumn("iou", bx.iou(F.col("nb"), F.col("pb")))
    return masks.match_ids_across_chunks(pairs.filter(F.col("iou") > 0), first)


def two_parts(m, empty):
    """``counts`` of two rectangles beside each other inside (mx, my, mw, mh); no pixels where ``empty``."""
    w1 = F.floor(F.col("mw") / 2)
    gap, h2 = F.col("frame_idx") % 3, F.floor(F.col("mh") / 3)
    column = lambda x, y, h: F.struct((x * views.HEIGHT + y).alias("s"), h.alias("n"))
    range_ = lambda lo, n: F.sequence(lo, lo + n - 1)
    left = F.transform(range_(F.col("mx"), w1), lambda x: column(x, F.col("my"), F.col("mh")))
    right = F.transform(range_(F.col("mx") + w1 + gap, w1), lambda x: column(x, F.col("my") + h2, F.col("mh") - h2))
    m = m.withColumn("on", F.concat(left, right))
    end = lambda k: F.when(k > 0, F.get("on", k - 1)["s"] + F.get("on", k - 1)["n"]).otherwise(F.lit(0))
    runs = F.flatten(F.transform("on", lambda o, k: F.array(o["s"] - end(k), o["n"])))
    rest = F.lit(views.HEIGHT * views.WIDTH) - end(F.size("on"))
    runs = F.when(empty, F.array(F.lit(views.HEIGHT * views.WIDTH).cast("long"))).otherwise(F.concat(runs, F.array(rest)))
    return m.withColumn("counts", rle.rle_encode(runs.cast("array<int>"))).drop("on")


def shaped(spark, sf):
    """Masks of two rectangles: an L, a mask in two parts, and none for every fifth object."""
    return two_parts(views.masks(spark, sf).drop("runs"), (F.col("frame_idx") + F.col("bird_id")) % 5 == 0)


SHAPED = [
    MASK,
    (
        "rc",
        """SELECT video_id, frame_idx, id, mx AS x, my AS y, mw // 2 AS w, mh AS h FROM mk WHERE (frame_idx + id) % 5 <> 0
      UNION ALL SELECT video_id, frame_idx, id, mx + mw // 2 + frame_idx % 3, my + mh // 3, mw // 2, mh - mh // 3 FROM mk WHERE (frame_idx + id) % 5 <> 0""",
    ),
    ("ar", "SELECT mk.video_id, mk.frame_idx, mk.id, coalesce(sum(w * h), 0) AS area FROM mk LEFT JOIN rc USING (video_id, frame_idx, id) GROUP BY ALL"),
    (
        "ov",
        """SELECT a.video_id, a.frame_idx, a.id AS id_a, b.id AS id_b, sum(greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0)
        * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)) AS inter
      FROM rc a JOIN rc b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.id < b.id GROUP BY ALL""",
    ),
]


def q_shape_overlaps(spark, sf):
    """All pairs of a frame, those that share nothing and empty masks included."""
    return rounded(masks.mask_overlaps(shaped(spark, sf), entity="bird_id"), "iou", digits=9)


SQL_SHAPE_OVERLAPS = O.r6(
    O._cte(O.DET, *SHAPED)
    + """SELECT a.video_id, a.frame_idx, a.id AS id_a, b.id AS id_b,
    CASE WHEN coalesce(inter, 0) > 0 THEN inter / (a.area + b.area - inter) ELSE 0.0::DOUBLE END AS iou
    FROM ar a JOIN ar b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.id < b.id
    LEFT JOIN ov ON ov.video_id = a.video_id AND ov.frame_idx = a.frame_idx AND ov.id_a = a.id AND ov.id_b = b.id""",
    "iou",
    digits=9,
)


def q_shape_geometry(spark, sf):
    """Area, centroid, signed angle and box of masks that are no rectangles."""
    m = shaped(spark, sf).select("video_id", "bird_id", "frame_idx", rle.mask_geometry("counts", masks.height()).alias("g"))
    out = m.select("video_id", "bird_id", "frame_idx", "g.mask_area", "g.centroid_x", "g.centroid_y", "g.elongation", "g.orientation", F.array_join("g.box", ",").alias("box"))
    return rounded(out, "mask_area", "centroid_x", "centroid_y", "elongation", "orientation", digits=6)


SQL_SHAPE_GEOMETRY = O.r6(
    O._cte(
        O.DET,
        *SHAPED,
        # Around the corner of the mask, so that the sums stay small.
        ("o", "SELECT rc.*, x - mx AS u, y - my AS v, mx, my FROM rc JOIN mk USING (video_id, frame_idx, id)"),
        (
            "s",
            """SELECT video_id, frame_idx, id, mx, my, CAST(sum(w * h) AS DOUBLE) AS n, sum(h * (w * u + w * (w - 1) / 2)) AS sx, sum(w * (h * v + h * (h - 1) / 2)) AS sy,
          sum(h * (w * u * u + u * w * (w - 1) + (w - 1) * w * (2 * w - 1) / 6)) AS sxx, sum(w * (h * v * v + v * h * (h - 1) + (h - 1) * h * (2 * h - 1) / 6)) AS syy,
          sum((w * u + w * (w - 1) / 2) * (h * v + h * (h - 1) / 2)) AS sxy,
          min(x) || ',' || min(y) || ',' || (max(x + w) - 1) || ',' || (max(y + h) - 1) AS box FROM o GROUP BY ALL""",
        ),
        ("c", "SELECT *, sxx / n - (sx / n) ** 2 AS a, syy / n - (sy / n) ** 2 AS b, sxy / n - sx / n * (sy / n) AS c FROM s"),
    )
    + """SELECT mk.video_id, mk.id AS bird_id, mk.frame_idx, coalesce(n, 0) AS mask_area, c.mx + sx / n AS centroid_x, c.my + sy / n AS centroid_y,
    sqrt((a + b + sqrt((a - b) ** 2 + 4 * c.c * c.c)) / (a + b - sqrt((a - b) ** 2 + 4 * c.c * c.c))) AS elongation,
    0.5 * atan2(2 * c.c, a - b) AS orientation, coalesce(box, '0,0,0,0') AS box FROM mk LEFT JOIN c USING (video_id, frame_idx, id)""",
    "mask_area",
    "centroid_x",
    "centroid_y",
    "elongation",
    "orientation",
)


def _guarded(out):
    """Ratios and shape statistics of what is constant but for rounding mean nothing on either side."""
    still = lambda c: F.col(f"{c}_std") < 1e-9
    for c in features.FEATURES:
        near = F.abs(F.col(f"{c}_mean")) > 1e-9
        out = out.withColumns({f"{c}_cv": F.when(near, F.col(f"{c}_cv")), **{f"{c}_{k}": F.when(~still(c), F.col(f"{c}_{k}")) for k in ("skew", "kurt")}})
    return out


def q_mask_window_summary(spark, sf):
    """All features of mask tracks, summarised by window: repaired, labelled tracks with masks in two parts."""
    t, _ = D.complete(spark, sf)
    b = [F.get("bbox", F.lit(k)) for k in range(4)]
    m = t.withColumns({"mx": F.floor(b[0]), "my": F.floor(b[1]), "mw": F.floor(b[2] - b[0]), "mh": F.floor(b[3] - b[1])})
    m = two_parts(m, F.lit(False)).withColumn("size", F.array(F.lit(views.HEIGHT), F.lit(views.WIDTH)))
    spatial = masks.spatial_features(m).drop("bbox_area")
    out = features.summarise(features.frame_features(spatial, block=views.BLOCK))
    return rounded(_guarded(out), *[c for c in out.columns if c not in ("video_id", "bird_id", "window", "n_frames")], digits=7)


_MASK_SPAT = [
    ("kb", """SELECT *, CAST(floor(x1) AS BIGINT) AS mx, CAST(floor(y1) AS BIGINT) AS my, CAST(floor(x2 - x1) AS BIGINT) // 2 AS w, CAST(floor(y2 - y1) AS BIGINT) AS h FROM ktr"""),
    # Left part (0, 0, w, h), right part (d, t, w, h - t).
    ("kc", "SELECT *, w + frame_idx % 3 AS d, h // 3 AS t FROM kb"),
    (
        "kd",
        """SELECT *, CAST(w * h + w * (h - t) AS DOUBLE) AS n, h * w * (w - 1) / 2 + (h - t) * (w * d + w * (w - 1) / 2) AS sx, w * h * (h - 1) / 2 + w * ((h - t) * t + (h - t) * (h - t - 1) / 2) AS sy,
      h * ((w - 1) * w * (2 * w - 1) / 6) + (h - t) * (w * d * d + d * w * (w - 1) + (w - 1) * w * (2 * w - 1) / 6) AS sxx,
      w * ((h - 1) * h * (2 * h - 1) / 6) + w * ((h - t) * t * t + t * (h - t) * (h - t - 1) + (h - t - 1) * (h - t) * (2 * (h - t) - 1) / 6) AS syy,
      (w * (w - 1) / 2) * (h * (h - 1) / 2) + (w * d + w * (w - 1) / 2) * ((h - t) * t + (h - t) * (h - t - 1) / 2) AS sxy FROM kc""",
    ),
    ("ke", "SELECT *, sxx / n - (sx / n) ** 2 AS a, syy / n - (sy / n) ** 2 AS b, sxy / n - sx / n * (sy / n) AS c FROM kd"),
    ("kf", "SELECT *, (a + b + sqrt((a - b) ** 2 + 4 * c * c)) / 2 AS big, (a + b - sqrt((a - b) ** 2 + 4 * c * c)) / 2 AS little FROM ke"),
    (
        "spat",
        """SELECT video_id, bird_id, frame_idx, "window", n AS mask_area, CASE WHEN y2 > y1 THEN (x2 - x1) / (y2 - y1) END AS aspect_ratio,
      mx + sx / n AS cx, my + sy / n AS cy, sqrt(big / little) AS elongation, 0.5 * atan2(2 * c, a - b) AS orientation,
      n / ((d + w - 1) * (h - 1) - d * t / 2) AS solidity, sqrt(1 - little / big) AS eccentricity FROM kf""",
    ),
]
_CHANGES = """,
      orientation - lag(orientation) OVER w AS orientation_velocity, solidity - lag(solidity) OVER w AS solidity_change,
      elongation - lag(elongation) OVER w AS elongation_change
      FROM spat s LEFT JOIN nn"""


def _mask_summary_sql() -> str:
    rest = [(n, q.replace("\n      FROM spat s LEFT JOIN nn", _CHANGES)) for n, q in D.FEAT[len(D.WIN) + 1 :]]
    line = ", ".join(D._summary_sql(c) for c in features.FEATURES)
    names = [f"{c}_{s}" for c in features.FEATURES for s in D._STATS]
    shown = ", ".join(
        f"CASE WHEN {n.rsplit('_', 1)[0]}_std >= 1e-9 THEN round({n}, 7) END AS {n}" if n.endswith(("_skew", "_kurt")) else f"round({n}, 7) AS {n}" for n in names
    )
    return O._cte(*D.WIN, *_MASK_SPAT, *rest) + f'SELECT video_id, bird_id, "window", n_frames, {shown} FROM (SELECT video_id, bird_id, "window", count(*) AS n_frames, {line} FROM feat GROUP BY ALL)'


QUERIES = {
    "mask_round_trip": (q_round_trip, SQL_ROUND_TRIP),
    "mask_geometry": (q_mask_geometry, SQL_GEOMETRY),
    "mask_boxes": (q_mask_boxes, SQL_BOXES),
    "mask_overlaps": (q_mask_overlaps, SQL_OVERLAPS),
    "overlap_periods": (q_overlap_periods, SQL_OVERLAP_PERIODS),
    "mask_shape_overlaps": (q_shape_overlaps, SQL_SHAPE_OVERLAPS),
    "mask_shape_geometry": (q_shape_geometry, SQL_SHAPE_GEOMETRY),
    "mask_window_summary": (q_mask_window_summary, _mask_summary_sql()),
    "mask_frame_metrics": (q_mask_frames, SQL_MASK_FRAMES),
    "mask_spread_points": (q_spread_points, SQL_POINTS),
    "mask_body_thirds": (q_body_thirds, SQL_THIRDS),
    "chunk_id_matching": (q_chunk_id_matching, None),
}

"""SQL twins of the registered queries, for a relational check of the results."""

from __future__ import annotations

FPS = "25.0"


def _cte(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts) + "\n"


def video(key: str) -> str:
    return (
        f"'C' || CAST(1 + {key} % 5 AS VARCHAR) || 'G' || CAST(1 + ({key} // 5) % 3 AS VARCHAR)"
        f" || 'D' || CAST(28 + ({key} // 15) % 2 AS VARCHAR)"
    )


DET = (
    "det",
    f"""SELECT {video('k')} AS video_id, CAST(k // 30 AS INTEGER) AS frame_idx, ln AS track_id,
    x1, y1, x1 + 40.0::DOUBLE + 300.0::DOUBLE * tax AS x2, y1 + 50.0::DOUBLE AS y2,
    (x1 + (x1 + 40.0::DOUBLE + 300.0::DOUBLE * tax)) / 2 / 640.0::DOUBLE AS cx_norm,
    (y1 + (y1 + 50.0::DOUBLE)) / 2 / 480.0::DOUBLE AS cy_norm, confidence, tracker_score
  FROM (SELECT l_orderkey AS k, CAST(l_linenumber AS INTEGER) AS ln,
          min(l_linenumber * 60.0::DOUBLE + l_quantity) AS x1,
          min(100.0::DOUBLE + 200.0::DOUBLE * l_discount) AS y1, max(l_tax) AS tax,
          min(1.0::DOUBLE - l_discount) AS confidence,
          min(1.0::DOUBLE - 5.0::DOUBLE * l_tax) AS tracker_score
        FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)


def iou(a: str, b: str) -> str:
    inter = (
        f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0)"
        f" * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"
    )
    area = "greatest(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1), 0)"
    union = f"({area.format(a)} + {area.format(b)} - {inter})"
    return f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0 END)"


PAIRS = (
    "pairs",
    f"""SELECT a.video_id, a.frame_idx, a.track_id AS ia, b.track_id AS ib, {iou('a', 'b')} AS iou,
    sqrt((a.cx_norm - b.cx_norm) * (a.cx_norm - b.cx_norm)
       + (a.cy_norm - b.cy_norm) * (a.cy_norm - b.cy_norm)) AS dist
  FROM det a JOIN det b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx
    AND a.track_id < b.track_id""",
)


def frames_cte(iou_thr: float = 0.15, near: float = 0.15, sep: float = 0.15) -> list[tuple[str, str]]:
    return [
        DET,
        PAIRS,
        (
            "pf",
            f"""SELECT video_id, frame_idx, min(dist) AS mn, avg(dist) AS me,
      avg(CASE WHEN dist < {near} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cc, max(iou) AS mi, avg(iou) AS ai,
      count(*) FILTER (WHERE iou > {iou_thr}) AS no FROM pairs GROUP BY ALL""",
        ),
        (
            "fr",
            """SELECT video_id, frame_idx, count(*) AS num_objects,
      string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY track_id) AS objects_present,
      avg(greatest((x2 - x1) * (y2 - y1), 0)) AS mean_bbox_area,
      min(greatest((x2 - x1) * (y2 - y1), 0)) AS min_bbox_area,
      max(greatest((x2 - x1) * (y2 - y1), 0)) AS max_bbox_area,
      var_pop(greatest((x2 - x1) * (y2 - y1), 0)) AS bbox_area_variance,
      avg(confidence) AS mean_confidence FROM det GROUP BY ALL""",
        ),
        (
            "fm0",
            """SELECT fr.*, coalesce(mn, 'inf'::DOUBLE) AS min_centroid_distance,
      coalesce(me, 'inf'::DOUBLE) AS mean_centroid_distance, coalesce(cc, 0) AS clustering_coefficient,
      coalesce(mi, 0) AS max_pairwise_bbox_iou, coalesce(ai, 0) AS mean_pairwise_bbox_iou,
      coalesce(no, 0) AS num_overlapping_pairs
      FROM fr LEFT JOIN pf USING (video_id, frame_idx)""",
        ),
        (
            "fm",
            f"""SELECT *, (max_pairwise_bbox_iou > {iou_thr} OR clustering_coefficient > 0.5) AS is_high_occlusion,
      CASE WHEN num_objects < 3 OR num_overlapping_pairs > 0 OR min_centroid_distance = 'inf'::DOUBLE
        OR min_centroid_distance < {sep} THEN 0.0
        ELSE least(min_centroid_distance, 1.0) * (1.0 - clustering_coefficient) END AS separation_score,
      coalesce(lag(num_objects) OVER (PARTITION BY video_id ORDER BY frame_idx) <> num_objects, FALSE)
        AS is_object_count_change FROM fm0""",
        ),
    ]


def islands(src: str, keys: str, order: str, step: str, extra: str = "") -> str:
    """Plain-window gaps and islands over ``src``."""
    return f"""SELECT {keys}, min({order}) AS run_start, max({order}) AS run_end, count(*) AS n_rows{extra}
    FROM (SELECT *, sum(brk) OVER (PARTITION BY {keys} ORDER BY {order}) AS grp FROM (
      SELECT *, CASE WHEN {order} - lag({order}) OVER (PARTITION BY {keys} ORDER BY {order}) <= {step}
        THEN 0 ELSE 1 END AS brk FROM {src})) GROUP BY {keys}, grp"""


def r6(sql: str, *cols: str, digits: int = 6) -> str:
    """Round double columns on the outside."""
    rounded = ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rounded}) FROM ({sql})"

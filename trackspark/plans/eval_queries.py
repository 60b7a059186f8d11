"""Registered queries: tracking evaluation. Truth and predictions both come from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import boxes as bx
from trackspark.operators import moteval
from trackspark.plans import oracle as O
from trackspark.plans import views
from trackspark.plans.scan_queries import rounded
from trackspark.session import cut_lineage


def recorded(spark, sf):
    """Truth and predictions, read from one stored table of the detections."""
    d = views.detections(spark, sf).select("video_id", "frame_idx", "track_id", "x1", "y1", "x2", "y2", "confidence")
    d = cut_lineage(d, "detections")
    return truth(d), predictions(d)


def truth(d):
    return d.select("video_id", "frame_idx", F.col("track_id").cast("long").alias("id"), bx.box().alias("box"))


def predictions(d):
    """Two variants of every detection: 'rotated' renames ids every 40 frames, 'shifted' moves boxes."""
    n = F.col("track_id").cast("long")
    turn = F.floor(F.col("frame_idx") / 40)
    dx = (F.col("confidence") - 0.9) * 400
    rotated = d.select(
        F.lit("rotated").alias("variant"), "video_id", "frame_idx", ((n + turn) % 7 + 1).alias("id"), bx.box().alias("box")
    )
    shifted = d.select(
        F.lit("shifted").alias("variant"),
        "video_id",
        "frame_idx",
        (n + 10).alias("id"),
        bx.box(F.col("x1") + dx, "y1", F.col("x2") + dx, "y2").alias("box"),
    )
    return rotated.unionByName(shifted)


PRED = [
    (
        "pred",
        """SELECT 'rotated' AS variant, video_id, frame_idx, CAST((track_id + frame_idx // 40) % 7 + 1 AS BIGINT) AS id, x1, y1, x2, y2 FROM det
      UNION ALL SELECT 'shifted', video_id, frame_idx, track_id + 10, x1 + (confidence - 0.9::DOUBLE) * 400, y1,
        x2 + (confidence - 0.9::DOUBLE) * 400, y2 FROM det""",
    ),
    (
        "bp",
        f"""SELECT p.variant, t.video_id, t.frame_idx, CAST(t.track_id AS BIGINT) AS gt_id, p.id AS pred_id, {O.iou('t', 'p')} AS iou
      FROM det t JOIN pred p ON p.video_id = t.video_id AND p.frame_idx = t.frame_idx""",
    ),
]


def q_box_pairs(spark, sf):
    out = moteval.box_pairs(*recorded(spark, sf), min_iou=0.3)
    return out.groupBy("variant", "video_id", "gt_id", "pred_id").agg(
        F.count("*").alias("n"), F.round(F.sum("iou"), 6).alias("total")
    )


SQL_BOX_PAIRS = (
    O._cte(O.DET, *PRED)
    + """SELECT variant, video_id, gt_id, pred_id, count(*) AS n, round(sum(iou), 6) AS total FROM bp
    WHERE iou > 0 AND iou >= 0.3 GROUP BY ALL"""
)


def _counts(spark, sf):
    t, p = recorded(spark, sf)
    met = moteval.frame_pairs(t, p, min_iou=0.5)
    events = cut_lineage(moteval.clear_events(t, p, p, met=met), "events")
    return moteval.clear_counts(events), moteval.identity_counts(t, p, p, met=met)


def _mot(level):
    def run(spark, sf):
        out = moteval.mot_scores(*_counts(spark, sf), level=level)
        return rounded(out, "mota", "motp", "precision", "recall", "idp", "idr", "idf1")

    return run


def _hota(level):
    def run(spark, sf):
        t, p = recorded(spark, sf)
        out = moteval.hota_scores(moteval.hota_terms(t, p, p), level=level)
        return rounded(out, *[c for c in out.columns if c not in ("variant", "video_id", "cage")])

    return run


def q_mot_rows(spark, sf):
    out = moteval.mot_rows(views.detections(spark, sf), entity="track_id", score="confidence")
    return out.select("video_id", "frame_idx", F.split("line", ",")[1].cast("int").alias("id"), "line")


# printf rounds half-way cases differently from the JVM only on exact binary ties; none occur
# in two decimals of these boxes.
SQL_MOT_ROWS = (
    O._cte(O.DET)
    + """SELECT video_id, frame_idx, track_id AS id, printf('%d,%d,%.2f,%.2f,%.2f,%.2f,%.4f,-1,-1,-1', frame_idx, track_id,
    x1, y1, x2 - x1, y2 - y1, confidence) AS line FROM det"""
)


def q_variant_spread(spark, sf):
    t, p = recorded(spark, sf)
    per_video = moteval.hota_scores(moteval.hota_terms(t, p, p))
    out = moteval.variant_spread(per_video, reference="shifted", metrics=("HOTA", "LocA"))
    return rounded(out, *[c for c in out.columns if c != "variant"])


def q_expected_outputs(spark, sf):
    """A variant without predictions still gets its rows, with zero counts."""
    _, p = recorded(spark, sf)
    v = p.select("variant").distinct().unionByName(spark.createDataFrame([("absent",)], "variant string"))
    return moteval.expected_outputs(p, v, views.videos(spark, sf))


SQL_EXPECTED = (
    O._cte(
        O.DET,
        *PRED,
        ("v", f"SELECT DISTINCT {O.video('o_orderkey')} AS video_id FROM orders"),
        ("g", "SELECT variant, video_id FROM v CROSS JOIN (SELECT unnest(['rotated', 'shifted', 'absent']) AS variant)"),
    )
    + "SELECT g.variant, g.video_id, count(pred.id) AS n_rows FROM g LEFT JOIN pred USING (variant, video_id) GROUP BY ALL"
)


def q_box_counts_by_variant(spark, sf):
    pairs = moteval.box_pairs(*recorded(spark, sf), min_iou=0.5)
    n = pairs.groupBy("variant", "video_id").agg(F.count("*").alias("n"))
    return moteval.video_by_variant(n, "n", ["rotated", "shifted"])


SQL_BY_VARIANT = (
    O._cte(O.DET, *PRED)
    + """SELECT video_id, count(*) FILTER (WHERE variant = 'rotated') AS rotated,
    count(*) FILTER (WHERE variant = 'shifted') AS shifted FROM bp WHERE iou >= 0.5 GROUP BY ALL"""
)

# SQL twins of the scores. Truth ids are 1 to 7 and prediction ids map to 1 to 7, so matchings are
# spelled out truth id by truth id, with the set of used predictions as bits.
IDS = range(1, 8)
BIT = "CASE variant WHEN 'shifted' THEN pred_id - 10 ELSE pred_id END"
NONE = "[0, 0, 0, 0, 0, 0, 0]"


def _chosen(m: str, j: int, value: str) -> str:
    return f"list_concat(list_append({m}[1:{j - 1}], {value}), {m}[{j + 1}:7])"


def _best_matchings(edges: str, keys: str, value: str, name: str, lists: bool = True) -> list[tuple[str, str]]:
    """``name7``: for each group and set of used predictions the best total ``v`` (and its matching ``m``)."""
    k = ", ".join(keys.split())
    m0 = f", {NONE} AS m" if lists else ""
    parts = [(f"{name}0", f"SELECT DISTINCT {k}, 0 AS used, CAST(0 AS DOUBLE) AS v{m0} FROM {edges}")]
    for j in IDS:
        skip = f"SELECT {k}, used, v{', m' if lists else ''} FROM {name}{j - 1}"
        take = f"SELECT {k}, d.used | (1 << e.b) AS used, d.v + e.{value} AS v{', ' + _chosen('d.m', j, 'e.b') + ' AS m' if lists else ''}"
        take += f" FROM {name}{j - 1} d JOIN {edges} e USING ({k}) WHERE e.a = {j} AND (d.used >> e.b) & 1 = 0"
        best = ", max_by(m, v) AS m" if lists else ""
        parts.append((f"{name}{j}", f"SELECT {k}, used, max(v) AS v{best} FROM ({skip} UNION ALL {take}) GROUP BY {k}, used"))
    return parts


def _kept(a: int) -> str:
    """Whether matching ``m`` of a frame with valid sets ``w`` keeps the partner that ``p`` remembers of ``a``."""
    valid = lambda x: f"(st.p[{x}] > 0 AND (c.w[{x}] >> st.p[{x}]) & 1 = 1)"
    taken = " OR ".join(f"({valid(x)} AND st.p[{x}] = st.p[{a}])" for x in range(1, a)) or "FALSE"
    return f"(NOT {valid(a)} OR ({taken}) OR c.m[{a}] = st.p[{a}])"


def _matchings() -> list[tuple[str, str]]:
    """``x7``: all matchings of a frame, but those that leave out a pair whose boxes have no other."""
    parts = [("x0", f"SELECT DISTINCT variant, video_id, k, 0 AS used, 0 AS n, CAST(0 AS DOUBLE) AS s, {NONE} AS m FROM vp")]
    for j in IDS:
        parts.append(
            (
                f"x{j}",
                f"""SELECT x.* FROM x{j - 1} x ANTI JOIN (SELECT * FROM vp WHERE a = {j} AND alone) USING (variant, video_id, k)
      UNION ALL SELECT variant, video_id, k, x.used | (1 << e.b), x.n + 1, x.s + e.iou, {_chosen('x.m', j, 'e.b')}
        FROM x{j - 1} x JOIN vp e USING (variant, video_id, k) WHERE e.a = {j} AND (x.used >> e.b) & 1 = 0""",
            )
        )
    return parts


CLEAR = [
    (
        "vp0",
        f"""SELECT variant, video_id, frame_idx, gt_id AS a, {BIT} AS b, iou,
      dense_rank() OVER (PARTITION BY variant, video_id ORDER BY frame_idx) AS k FROM bp WHERE iou > 0 AND iou >= 0.5""",
    ),
    (
        "vp",
        """SELECT *, count(*) OVER (PARTITION BY variant, video_id, k, a) = 1
        AND count(*) OVER (PARTITION BY variant, video_id, k, b) = 1 AS alone FROM vp0""",
    ),
    *_matchings(),
    (
        "valid",
        "SELECT variant, video_id, k, ["
        + ", ".join(f"coalesce(bit_or(1 << b) FILTER (WHERE a = {j}), 0)" for j in IDS)
        + "] AS w FROM vp GROUP BY ALL",
    ),
    ("cand", "SELECT x7.*, valid.w FROM x7 JOIN valid USING (variant, video_id, k)"),
    (
        "st",
        f"""SELECT variant, video_id, CAST(0 AS BIGINT) AS k, {NONE} AS p, {NONE} AS q, {NONE} AS m FROM vp GROUP BY variant, video_id
      UNION ALL SELECT variant, video_id, k, [{', '.join(f'CASE WHEN m[{j}] > 0 THEN m[{j}] ELSE p[{j}] END' for j in IDS)}], p, m FROM (
        SELECT st.variant, st.video_id, c.k, st.p, max_by(c.m, c.n * 100 + c.s) AS m
        FROM st JOIN cand c ON c.variant = st.variant AND c.video_id = st.video_id AND c.k = st.k + 1
        WHERE {' AND '.join(_kept(j) for j in IDS)} GROUP BY st.variant, st.video_id, c.k, st.p)""",
    ),
    ("won", f"SELECT variant, video_id, k, unnest([{', '.join(map(str, IDS))}]) AS a, unnest(m) AS b, unnest(q) AS q FROM st WHERE k > 0"),
    (
        "hits",
        """SELECT variant, video_id, frame_idx, a, b, iou, q > 0 AND q <> b AS switched
      FROM won JOIN vp USING (variant, video_id, k, a, b)""",
    ),
    (
        "own",
        """SELECT v.variant, det.video_id, det.frame_idx, det.track_id AS a, h.iou, h.b IS NOT NULL AS hit, coalesce(h.switched, FALSE) AS switched
      FROM det CROSS JOIN (SELECT DISTINCT variant FROM pred) v
      LEFT JOIN hits h ON h.variant = v.variant AND h.video_id = det.video_id AND h.frame_idx = det.frame_idx AND h.a = det.track_id""",
    ),
    (
        "life",
        """SELECT *, NOT hit AND coalesce(lag(hit) OVER w, FALSE) AND frame_idx < max(CASE WHEN hit THEN frame_idx END) OVER (PARTITION BY variant, video_id, a) AS frag
      FROM own WINDOW w AS (PARTITION BY variant, video_id, a ORDER BY frame_idx)""",
    ),
    ("objects", "SELECT variant, video_id, a, avg(CAST(hit AS INTEGER)) AS ratio, count(*) FILTER (WHERE frag) AS frag FROM life GROUP BY ALL"),
    ("met", "SELECT variant, video_id, a, b, CAST(count(*) AS DOUBLE) AS n FROM vp GROUP BY ALL"),
    *_best_matchings("met", "variant video_id", "n", "y", lists=False),
    (
        "counts",
        """SELECT variant, video_id, count(DISTINCT frame_idx) AS num_frames, count(DISTINCT a) AS num_unique_objects, count(*) AS num_objects,
      count(*) FILTER (WHERE hit) AS det, count(*) FILTER (WHERE switched) AS num_switches, count(*) FILTER (WHERE NOT hit) AS num_misses,
      sum(CASE WHEN hit THEN 1 - iou ELSE 0 END) AS distance FROM own GROUP BY ALL""",
    ),
    (
        "per_video",
        """SELECT c.*, p.n - c.det AS num_false_positives, o.mostly_tracked, o.partially_tracked, o.mostly_lost, o.num_fragmentations,
      coalesce(i.tp, 0) AS tp, c.num_objects - coalesce(i.tp, 0) AS fn, p.n - coalesce(i.tp, 0) AS fp FROM counts c
      JOIN (SELECT variant, video_id, count(*) AS n FROM pred GROUP BY ALL) p USING (variant, video_id)
      JOIN (SELECT variant, video_id, count(*) FILTER (WHERE ratio >= 0.8) AS mostly_tracked, count(*) FILTER (WHERE ratio >= 0.2 AND ratio < 0.8) AS partially_tracked,
        count(*) FILTER (WHERE ratio < 0.2) AS mostly_lost, sum(frag) AS num_fragmentations FROM objects GROUP BY ALL) o USING (variant, video_id)
      LEFT JOIN (SELECT variant, video_id, max(v) AS tp FROM y7 GROUP BY ALL) i USING (variant, video_id)""",
    ),
]
LEVELS = {"video": "variant, video_id", "cage": "variant, regexp_extract(video_id, 'C[0-9]+') AS cage", "all": "variant"}


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _mot_sql(level: str) -> str:
    sums = ["num_frames", "num_unique_objects", "num_objects", "num_switches", "num_false_positives", "num_misses"]
    sums += ["mostly_tracked", "partially_tracked", "mostly_lost", "num_fragmentations"]
    ratio = "round(CAST({} AS DOUBLE) / nullif({}, 0), 6) AS {}"
    det, objects, positives = "sum(det)", "sum(num_objects)", "(sum(det) + sum(num_false_positives))"
    scores = [
        "round(1 - CAST(sum(num_misses) + sum(num_switches) + sum(num_false_positives) AS DOUBLE) / nullif(sum(num_objects), 0), 6) AS mota",
        ratio.format("sum(distance)", det, "motp"),
        ratio.format(det, positives, "precision"),
        ratio.format(det, objects, "recall"),
        ratio.format("sum(tp)", "sum(tp + fp)", "idp"),
        ratio.format("sum(tp)", "sum(tp + fn)", "idr"),
        ratio.format("2 * sum(tp)", "sum(2 * tp + fp + fn)", "idf1"),
    ]
    counts = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in sums)
    return _recursive(O._cte(O.DET, *PRED, *CLEAR)) + f"SELECT {LEVELS[level]}, {counts}, {', '.join(scores)} FROM per_video GROUP BY ALL"


HOTA = [
    ("hp", f"SELECT variant, video_id, frame_idx, gt_id AS a, {BIT} AS b, iou FROM bp WHERE iou > 0"),
    ("gc", "SELECT variant, video_id, track_id AS a, count(*) AS gc FROM det CROSS JOIN (SELECT DISTINCT variant FROM pred) GROUP BY ALL"),
    ("pc", f"SELECT variant, video_id, {BIT} AS b, count(*) AS pc FROM (SELECT variant, video_id, id AS pred_id FROM pred) GROUP BY ALL"),
    (
        "pot",
        """SELECT variant, video_id, a, b, sum(s) AS pot FROM (SELECT *, iou / (sum(iou) OVER (PARTITION BY variant, video_id, frame_idx, a)
      + sum(iou) OVER (PARTITION BY variant, video_id, frame_idx, b) - iou) AS s FROM hp) GROUP BY ALL""",
    ),
    ("edge", "SELECT hp.*, iou * pot / (gc + pc - pot) AS s FROM hp JOIN pot USING (variant, video_id, a, b) JOIN gc USING (variant, video_id, a) JOIN pc USING (variant, video_id, b)"),
    *_best_matchings("edge", "variant video_id frame_idx", "s", "z"),
    ("top", f"SELECT variant, video_id, frame_idx, unnest([{', '.join(map(str, IDS))}]) AS a, unnest(m) AS b FROM (SELECT variant, video_id, frame_idx, max_by(m, v) AS m FROM z7 GROUP BY ALL)"),
    (
        "levels",
        f"""SELECT variant, video_id, alpha, a, b, count(*) AS m, sum(iou) AS loc FROM top JOIN hp USING (variant, video_id, frame_idx, a, b)
      JOIN (SELECT unnest({moteval.ALPHAS}::DOUBLE[]) AS alpha) ON iou >= alpha - {moteval.EPS} GROUP BY ALL""",
    ),
    (
        "term",
        """SELECT variant, video_id, alpha, sum(m) AS tp, sum(loc) AS loc, sum(m * m / (gc + pc - m)) AS ass_a, sum(m * m / gc) AS ass_re, sum(m * m / pc) AS ass_pr
      FROM levels JOIN gc USING (variant, video_id, a) JOIN pc USING (variant, video_id, b) GROUP BY ALL""",
    ),
    (
        "full_terms",
        f"""SELECT g.variant, g.video_id, alpha, coalesce(tp, 0) AS tp, g.n - coalesce(tp, 0) AS fn, p.n - coalesce(tp, 0) AS fp,
      coalesce(loc, 0) AS loc, coalesce(ass_a, 0) AS ass_a, coalesce(ass_re, 0) AS ass_re, coalesce(ass_pr, 0) AS ass_pr
      FROM (SELECT variant, video_id, sum(gc) AS n FROM gc GROUP BY ALL) g JOIN (SELECT variant, video_id, sum(pc) AS n FROM pc GROUP BY ALL) p USING (variant, video_id)
      CROSS JOIN (SELECT unnest({moteval.ALPHAS}::DOUBLE[]) AS alpha) LEFT JOIN term USING (variant, video_id, alpha)""",
    ),
]


def _hota_sql(level: str, digits: int | None = 6) -> str:
    keys = LEVELS[level]
    over = "CAST({} AS DOUBLE) / greatest({}, 1)"
    parts = {
        "DetA": over.format("tp", "tp + fn + fp"),
        "DetRe": over.format("tp", "tp + fn"),
        "DetPr": over.format("tp", "tp + fp"),
        "AssA": over.format("ass_a", "tp"),
        "AssRe": over.format("ass_re", "tp"),
        "AssPr": over.format("ass_pr", "tp"),
        "LocA": "CASE WHEN tp > 0 THEN loc / tp ELSE 1.0 END",
    }
    names = [*parts, "HOTA", "OWTA"]
    inner = ", ".join(f"{v} AS {k}" for k, v in parts.items())
    plain = keys.split(" AS ")[0] if level != "cage" else "variant, cage"
    out = ", ".join(f"avg({n}) AS {n}" if digits is None else f"round(avg({n}), {digits}) AS {n}" for n in names)
    return f"""SELECT {plain}, {out} FROM (SELECT *, sqrt(DetA * AssA) AS HOTA, sqrt(DetRe * AssA) AS OWTA FROM (
      SELECT {plain}, alpha, {inner} FROM (SELECT {keys}, alpha, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(loc) AS loc,
        sum(ass_a) AS ass_a, sum(ass_re) AS ass_re, sum(ass_pr) AS ass_pr FROM full_terms GROUP BY ALL))) GROUP BY ALL"""


SQL_SPREAD = (
    O._cte(O.DET, *PRED, *HOTA, ("per", _hota_sql("video", None)))
    + """SELECT v.variant, round(v.h, 6) AS HOTA_mean, round(v.hs, 6) AS HOTA_sd, round(v.l, 6) AS LocA_mean, round(v.ls, 6) AS LocA_sd,
    round(v.h - r.h, 6) AS HOTA_delta, round(v.l - r.l, 6) AS LocA_delta
    FROM (SELECT variant, avg(HOTA) AS h, stddev_samp(HOTA) AS hs, avg(LocA) AS l, stddev_samp(LocA) AS ls FROM per GROUP BY variant) v,
    (SELECT avg(HOTA) AS h, avg(LocA) AS l FROM per WHERE variant = 'shifted') r"""
)

QUERIES = {
    "mot_box_pairs": (q_box_pairs, SQL_BOX_PAIRS),
    "mot_expected_outputs": (q_expected_outputs, SQL_EXPECTED),
    "mot_video_by_variant": (q_box_counts_by_variant, SQL_BY_VARIANT),
    "mot_rows": (q_mot_rows, SQL_MOT_ROWS),
    "mot_scores_video": (_mot("video"), _mot_sql("video")),
    "mot_scores_cage": (_mot("cage"), _mot_sql("cage")),
    "mot_scores_all": (_mot("all"), _mot_sql("all")),
    "hota_video": (_hota("video"), O._cte(O.DET, *PRED, *HOTA) + _hota_sql("video")),
    "hota_cage": (_hota("cage"), O._cte(O.DET, *PRED, *HOTA) + _hota_sql("cage")),
    "hota_all": (_hota("all"), O._cte(O.DET, *PRED, *HOTA) + _hota_sql("all")),
    "variant_spread": (q_variant_spread, SQL_SPREAD),
}

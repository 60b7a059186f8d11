"""Registered queries: sequences, folds, class metrics and analysis reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import pooling, text
from trackspark.operators import classes, distributions, events, reports, sequences
from trackspark.plans import dataset_queries as D
from trackspark.plans import oracle as O
from trackspark.plans import scan_queries as S
from trackspark.plans import views
from trackspark.plans.scan_queries import rounded
from trackspark.session import cut_lineage

# --- sequences over embeddings ----------------------------------------------------------


def _emb(spark, sf):
    return views.table(spark, sf, "embeddings")


def _steps(spark, sf):
    """Each embedding as a sequence of 16 steps of 4 values."""
    return _emb(spark, sf).withColumn("seq", pooling.chunk_array("embedding", 4))


def _long(df, col):
    """(vec_id, step, dim, value) rows of an array of vectors."""
    return (
        df.select("vec_id", F.posexplode(col).alias("step", "v"))
        .select("vec_id", "step", F.posexplode("v").alias("dim", "value"))
        .withColumn("value", F.round("value", 6))
    )


def q_segment_pool(spark, sf):
    return _long(_steps(spark, sf).withColumn("p", pooling.segment_pool("seq", 5)), "p")


def q_segment_pool_z(spark, sf):
    return _long(sequences.pooled_sequences(_steps(spark, sf), 5), "pooled")


_E = ("e", "SELECT vec_id, i // 4 AS step, i % 4 AS dim, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)")
_POOL = """SELECT vec_id, CAST(b AS INTEGER) AS step, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS value
    FROM {src}, range(5) t(b) WHERE step >= (b * 16) // 5 AND step < ((b + 1) * 16 + 4) // 5 GROUP BY vec_id, b, dim"""
SQL_POOL = O._cte(_E) + _POOL.format(src="e")
SQL_POOL_Z = O._cte(
    _E,
    ("z", "SELECT vec_id, step, e.dim, (x - m) / s AS x FROM e JOIN (SELECT dim, avg(x) AS m, stddev_samp(x) AS s FROM e GROUP BY dim) d ON d.dim = e.dim"),
) + _POOL.format(src="z")


def q_mean_pool(spark, sf):
    out = _steps(spark, sf).select("vec_id", F.posexplode(pooling.mean_pool("seq")).alias("dim", "value"))
    return rounded(out, "value")


SQL_MEAN_POOL = (
    O._cte(_E) + "SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS value FROM e GROUP BY ALL"
)


def q_concat_embeddings(spark, sf):
    e = _emb(spark, sf)
    a = e.select("vec_id", F.slice("embedding", 25, 40).alias("vec"))
    b = e.select("vec_id", F.slice("embedding", 1, 24).alias("vec"))
    out = sequences.join_embeddings(a, b, keys=["vec_id"])
    return out.select("vec_id", F.posexplode("vec").alias("dim", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


SQL_CONCAT = """SELECT vec_id, CAST(p AS INTEGER) AS dim, round(CAST(embedding[CASE WHEN p < 40 THEN p + 25 ELSE p - 39 END] AS DOUBLE), 6) AS value
    FROM (SELECT vec_id, embedding, unnest(range(64)) AS p FROM embeddings)"""


def q_scale_columns(spark, sf):
    o = views.table(spark, sf, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_custkey") % 9 != 0, F.col("o_totalprice")).alias("x"))
    return rounded(sequences.scale_columns(rows, ["x"], clip=1.5), "x")


SQL_SCALE = (
    O._cte(
        ("r", "SELECT o_orderkey, CASE WHEN o_custkey % 9 <> 0 THEN o_totalprice END AS x FROM orders"),
        ("f", "SELECT o_orderkey, coalesce(x, (SELECT median(x) FROM r)) AS x FROM r"),
    )
    + """SELECT o_orderkey, round(greatest(least((x - m) / s, 1.5), -1.5), 6) AS x
    FROM f CROSS JOIN (SELECT avg(x) AS m, stddev_samp(x) AS s FROM f)"""
)


def _windowed(spark, sf):
    """Tracks with a window per 25 frames: enough for the sequence operators."""
    t = views.tracks(spark, sf).withColumnRenamed("tracking_id", "bird_id")
    return t.withColumn("window", F.floor(F.col("frame_idx") / 25).cast("int"))


WDET = ("wd", 'SELECT *, track_id AS bird_id, frame_idx // 25 AS "window" FROM det')


def q_even_rows(spark, sf):
    return sequences.even_rows(_windowed(spark, sf), 4).select("video_id", "bird_id", "window", "frame_idx")


SQL_EVEN = (
    O._cte(
        O.DET,
        WDET,
        (
            "n",
            """SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY video_id, bird_id, "window") AS c
          FROM wd WINDOW w AS (PARTITION BY video_id, bird_id, "window" ORDER BY frame_idx)""",
        ),
    )
    + 'SELECT video_id, bird_id, "window", frame_idx FROM n WHERE c <= 4 OR list_contains([0, (c - 1) // 3, 2 * (c - 1) // 3, c - 1], rn)'
)


def q_clip_plan(spark, sf):
    return sequences.clip_plan(_windowed(spark, sf), 8, steps_per_clip=4)


SQL_CLIPS = (
    O._cte(
        O.DET,
        WDET,
        (
            "n",
            """SELECT *, (row_number() OVER (PARTITION BY video_id, bird_id, "window" ORDER BY frame_idx) - 1) // 8 AS c FROM wd""",
        ),
    )
    + """SELECT video_id, bird_id, "window", CAST(c AS INTEGER) AS clip, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame,
    count(*) AS n_valid, 8 - count(*) AS n_pad, greatest((count(*) + 1) // 2, 1) AS valid_steps FROM n GROUP BY ALL"""
)


def q_crop_plan(spark, sf):
    out = sequences.crop_plan(_windowed(spark, sf), mode="union", size=256, frame_w=640, frame_h=480)
    return out.select(
        "video_id", "bird_id", "frame_idx", "crop_x", "crop_y", "patch_x0", "patch_x1", "patch_y0", "patch_y1"
    )


SQL_CROP = (
    O._cte(
        O.DET,
        WDET,
        (
            "u",
            """SELECT video_id, bird_id, "window", CAST(trunc((min(x1) + max(x2)) / 2) AS BIGINT) AS cx,
          CAST(trunc((min(y1) + max(y2)) / 2) AS BIGINT) AS cy FROM wd GROUP BY ALL""",
        ),
        (
            "o",
            """SELECT wd.*, greatest(0, least(cx - 128, 384)) AS ox, greatest(0, least(cy - 128, 224)) AS oy
          FROM wd JOIN u USING (video_id, bird_id, "window")""",
        ),
    )
    + """SELECT video_id, bird_id, frame_idx, ox AS crop_x, oy AS crop_y,
    greatest(0, CAST(trunc(x1) AS BIGINT) - ox) // 16 AS patch_x0,
    least(16, CAST(trunc(least(256, CAST(trunc(x2) AS BIGINT) - ox) * 0.0625) AS BIGINT) + 1) AS patch_x1,
    greatest(0, CAST(trunc(y1) AS BIGINT) - oy) // 16 AS patch_y0,
    least(16, CAST(trunc(least(256, CAST(trunc(y2) AS BIGINT) - oy) * 0.0625) AS BIGINT) + 1) AS patch_y1 FROM o"""
)

# --- folds ------------------------------------------------------------------------------


def q_cage_folds(spark, sf):
    return classes.cage_folds(views.videos(spark, sf))


def q_video_folds(spark, sf):
    return classes.video_folds(views.videos(spark, sf))


_V = ("v", f"SELECT DISTINCT {O.video('o_orderkey')} AS video_id FROM orders")
SQL_CAGE_FOLDS = (
    O._cte(_V, ("c", "SELECT DISTINCT substr(video_id, 1, 2) AS cage FROM v"))
    + "SELECT cage AS test_id, coalesce(lead(cage) OVER (ORDER BY cage), (SELECT min(cage) FROM c)) AS val_id FROM c"
)
SQL_VIDEO_FOLDS = (
    O._cte(
        _V,
        ("c", "SELECT DISTINCT substr(video_id, 1, 2) AS cage FROM v"),
        ("nx", "SELECT cage, coalesce(lead(cage) OVER (ORDER BY cage), (SELECT min(cage) FROM c)) AS nxt FROM c"),
        (
            "i",
            """SELECT video_id, substr(video_id, 1, 2) AS cage, row_number() OVER (PARTITION BY substr(video_id, 1, 2) ORDER BY video_id) - 1 AS i,
          count(*) OVER (PARTITION BY substr(video_id, 1, 2)) AS n FROM v""",
        ),
    )
    + """SELECT a.video_id AS test_id, b.video_id AS val_id FROM i a JOIN nx ON nx.cage = a.cage
    JOIN i b ON b.cage = nx.nxt AND b.i = a.i % b.n"""
)


def q_shuffled_folds(spark, sf):
    return classes.shuffled_folds(views.videos(spark, sf), 7, by="video")


# The first id of another cage after one's own on the circle of hashes.
SQL_SHUFFLED = (
    O._cte(_V, ("u", "SELECT DISTINCT video_id, substr(video_id, 1, 2) AS cage, md5(video_id || '/7') AS h FROM v"))
    + """SELECT a.video_id AS test_id, arg_min(b.video_id, (CASE WHEN b.h > a.h THEN '0' ELSE '1' END) || b.h) AS val_id
    FROM u a JOIN u b ON a.cage <> b.cage GROUP BY a.video_id"""
)


def q_split_counts(spark, sf):
    v = views.videos(spark, sf)
    tagged = classes.tag_splits(views.labels(spark, sf), classes.cage_folds(v))
    return tagged.groupBy("test_id", "split", "behav_label").agg(F.count("*").alias("n"))


SQL_SPLITS = (
    O._cte(*D.LAB, _V, ("c", "SELECT DISTINCT substr(video_id, 1, 2) AS cage FROM v"), ("fo", "SELECT cage AS test_id, coalesce(lead(cage) OVER (ORDER BY cage), (SELECT min(cage) FROM c)) AS val_id FROM c"))
    + """SELECT test_id, CASE WHEN substr(video_id, 1, 2) = test_id THEN 'test' WHEN substr(video_id, 1, 2) = val_id THEN 'val'
    ELSE 'train' END AS split, behav_label, count(*) AS n FROM lab CROSS JOIN fo GROUP BY ALL"""
)


def q_class_weights(spark, sf):
    out = classes.class_weights(
        views.labels(spark, sf), "behav_label", ["none", "worm", "locomotor", "social"], scheme="inv-sqrt"
    )
    return rounded(out, "weight")


SQL_WEIGHTS = (
    O._cte(
        *D.LAB,
        (
            "w",
            """SELECT c AS class, count(behav_label) AS n, 1 / sqrt(greatest(count(behav_label), 1)) AS r
          FROM (SELECT unnest(['none', 'worm', 'locomotor', 'social']) AS c) LEFT JOIN lab ON behav_label = c GROUP BY c""",
        ),
    )
    + "SELECT class, n, round(r / (SELECT sum(r) FROM w) * 4, 6) AS weight FROM w"
)

# --- class metrics over labels (true = quality, predicted = not toxic) --------------------


def _pred(spark, sf):
    l = views.table(spark, sf, "labels").join(
        views.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id"
    )
    return l.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.col("quality").cast("string").alias("true_label"),
        (1 - F.col("toxic")).cast("string").alias("pred_label"),
    )


_P = (
    "p",
    """SELECT doc_id, lang, source, n_chars, CAST(quality AS VARCHAR) AS true_label, CAST(1 - toxic AS VARCHAR) AS pred_label
    FROM labels JOIN documents USING (doc_id)""",
)
_CM = (
    "cm",
    """SELECT lang, t.c AS true_label, q.c AS pred_label, count(doc_id) AS n FROM (SELECT DISTINCT lang FROM p) l
    CROSS JOIN (SELECT unnest(['0', '1']) AS c) t CROSS JOIN (SELECT unnest(['0', '1']) AS c) q
    LEFT JOIN p ON p.lang = l.lang AND p.true_label = t.c AND p.pred_label = q.c GROUP BY ALL""",
)


def q_confusion(spark, sf):
    return classes.confusion(_pred(spark, sf), by=["lang"])


SQL_CONFUSION = O._cte(_P, (_CM[0], _CM[1].replace("SELECT lang,", "SELECT l.lang,"))) + "SELECT * FROM cm"
_CMX = (_CM[0], _CM[1].replace("SELECT lang,", "SELECT l.lang,"))
_SC = [
    (
        "m",
        """SELECT a.lang, a.c AS class, CAST(tp AS BIGINT) AS tp, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted
      FROM (SELECT lang, true_label AS c, sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) AS tp, sum(n) AS support FROM cm GROUP BY ALL) a
      JOIN (SELECT lang, pred_label AS c, sum(n) AS predicted FROM cm GROUP BY ALL) b ON a.lang = b.lang AND a.c = b.c""",
    ),
    (
        "pr",
        """SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
      CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM m""",
    ),
    (
        "sc",
        "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr",
    ),
]


def q_class_scores(spark, sf):
    out = classes.class_scores(classes.confusion(_pred(spark, sf), by=["lang"]), by=["lang"])
    return rounded(out, "precision", "recall", "f1")


SQL_SCORES = O.r6(O._cte(_P, _CMX, *_SC) + "SELECT * FROM sc", "precision", "recall", "f1")


def q_smoothed_scores(spark, sf):
    out = classes.smoothed_scores(classes.confusion(_pred(spark, sf), by=["lang"]), by=["lang"])
    return rounded(out, "precision", "recall", "f1")


SQL_SMOOTHED = O.r6(
    O._cte(_P, _CMX, *_SC)
    + """SELECT * EXCLUDE (f1) REPLACE (tp / greatest(predicted, 1) AS precision, tp / greatest(support, 1) AS recall),
    2 * (tp / greatest(predicted, 1)) * (tp / greatest(support, 1)) / (tp / greatest(predicted, 1) + tp / greatest(support, 1) + 1e-8) AS f1 FROM sc""",
    "precision",
    "recall",
    "f1",
)


def q_normalised_confusion(spark, sf):
    out = classes.normalised_confusion(classes.confusion(_pred(spark, sf), by=["lang"]), by=["lang"])
    return rounded(out, "share", "precision", "f1")


SQL_NORMALISED = O.r6(
    O._cte(_P, _CMX, *_SC)
    + """SELECT cm.lang, cm.true_label, cm.pred_label, n, CASE WHEN sum(n) OVER (PARTITION BY cm.lang, cm.true_label) > 0
      THEN n / sum(n) OVER (PARTITION BY cm.lang, cm.true_label) ELSE 0 END AS share, precision, f1, support
    FROM cm JOIN sc ON sc.lang = cm.lang AND sc.class = cm.true_label""",
    "share",
    "precision",
    "f1",
)


def q_fold_summary(spark, sf):
    cm = classes.confusion(_pred(spark, sf), by=["lang"])
    folds = classes.macro_f1(cm, by=["lang"]).select(F.col("lang").alias("test_id"), "macro_f1")
    pooled = classes.macro_f1(cm.groupBy("true_label", "pred_label").agg(F.sum("n").alias("n")))
    return rounded(classes.fold_summary(folds, pooled), "macro_f1")


SQL_FOLD_SUMMARY = (
    O._cte(
        _P,
        _CMX,
        *_SC,
        ("fo", "SELECT lang AS test_id, avg(f1) AS macro_f1 FROM sc GROUP BY lang"),
        (
            "po",
            """SELECT avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f FROM (
          SELECT coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r
          FROM (SELECT class, sum(tp) AS tp, sum(predicted) AS predicted, sum(support) AS support FROM sc GROUP BY class))""",
        ),
    )
    + """SELECT test_id, round(macro_f1, 6) AS macro_f1 FROM fo UNION ALL SELECT 'MEAN', round(avg(macro_f1), 6) FROM fo
    UNION ALL SELECT 'STD', round(stddev_samp(macro_f1), 6) FROM fo UNION ALL SELECT 'POOLED', round(f, 6) FROM po"""
)


def q_subset_scores(spark, sf):
    binned = reports.quantile_bins(_pred(spark, sf), "n_chars", 4, "q")
    subsets = F.filter(
        F.array(
            F.lit("all"),
            F.when(F.col("q") > 1, F.lit("minus_q1")),
            F.when(F.col("q") > 2, F.lit("minus_q1_q2")),
        ),
        lambda s: s.isNotNull(),
    )
    return rounded(classes.subset_scores(binned, subsets).select("subset", "class", "f1", "support"), "f1")


_Q = (
    "qb",
    """SELECT p.*, 1 + (n_chars > e[1])::INT + (n_chars > e[2])::INT + (n_chars > e[3])::INT AS q
    FROM p CROSS JOIN (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS e FROM p)""",
)
SQL_SUBSETS = O.r6(
    O._cte(
        _P,
        _Q,
        ("s", "SELECT 'all' AS lang, * EXCLUDE (lang) FROM qb UNION ALL SELECT 'minus_q1', * EXCLUDE (lang) FROM qb WHERE q > 1 UNION ALL SELECT 'minus_q1_q2', * EXCLUDE (lang) FROM qb WHERE q > 2"),
        (_CMX[0], _CMX[1].replace("FROM p)", "FROM s)").replace("LEFT JOIN p ON p.lang = l.lang AND p.true_label = t.c AND p.pred_label = q.c", "LEFT JOIN s ON s.lang = l.lang AND s.true_label = t.c AND s.pred_label = q.c")),
        *_SC,
    )
    + "SELECT lang AS subset, class, f1, support FROM sc",
    "f1",
)


def q_recall_by_quartile(spark, sf):
    binned = reports.quantile_bins(_pred(spark, sf), "n_chars", 4, "quartile")
    out = binned.groupBy("quartile").pivot("true_label", ["0", "1"]).agg(F.avg((F.col("true_label") == F.col("pred_label")).cast("double")))
    return rounded(out.withColumnRenamed("0", "recall_0").withColumnRenamed("1", "recall_1"), "recall_0", "recall_1")


SQL_QUARTILE = O.r6(
    O._cte(_P, _Q)
    + """SELECT q AS quartile, avg(CASE WHEN true_label = '0' THEN CASE WHEN pred_label = '0' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS recall_0,
    avg(CASE WHEN true_label = '1' THEN CASE WHEN pred_label = '1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS recall_1 FROM qb GROUP BY q""",
    "recall_0",
    "recall_1",
)


def q_main_confusion(spark, sf):
    out = classes.recall_with_main_confusion(_pred(spark, sf), sub="source", min_rows=5)
    return rounded(out, "recall", "confused_share")


SQL_MAIN_CONFUSION = O.r6(
    O._cte(
        _P,
        ("g", "SELECT true_label, source, count(*) AS n, count(*) FILTER (WHERE true_label = pred_label) AS h, count(*) FILTER (WHERE true_label <> pred_label) AS w FROM p GROUP BY ALL"),
    )
    + """SELECT true_label, source, n, h / n AS recall, CASE WHEN w > 0 THEN CASE WHEN true_label = '0' THEN '1' ELSE '0' END END AS confused_with,
    CASE WHEN w > 0 THEN w / n END AS confused_share FROM g WHERE n >= 5""",
    "recall",
    "confused_share",
)


def q_linear_baseline(spark, sf):
    """Leave-one-cage-out baseline on the embeddings; vectors play the part of windows."""
    e = _emb(spark, sf).withColumn("video_id", views.video_of(F.col("vec_id")))
    w = classes.class_weights(e.withColumn("c", F.col("label").cast("string")), "c", [str(i) for i in range(10)])
    rows = e.join(F.broadcast(w.select(F.col("class").cast("int").alias("label"), "weight")), "label")
    test = F.substring("video_id", 1, 2) == "C1"
    rows = rows.withColumn("features", F.transform("embedding", lambda x: x.cast("double")))
    out = classes.fit_predict(rows.filter(~test), rows.filter(test), classes=10)
    cm = classes.confusion(out.select(F.col("label").cast("string").alias("true_label"), F.col("prediction").cast("int").cast("string").alias("pred_label")))
    return rounded(classes.class_scores(cm), "precision", "recall", "f1")


LABELS = [str(i) for i in range(10)]


def _ridge(spark, sf):
    """Every vector with the class that the fold without its cage gives it."""
    e = _emb(spark, sf).withColumn("video_id", views.video_of(F.col("vec_id")))
    rows = e.select("vec_id", F.substring("video_id", 1, 2).alias("cage"), F.col("label").cast("string").alias("true_label"), "embedding")
    out = classes.ridge_folds(rows, LABELS, group="cage", label="true_label", features="embedding")
    return out.withColumnRenamed("prediction", "pred_label")


def q_ridge_folds(spark, sf):
    """Leave-one-cage-out: every fold, then MEAN, STD and POOLED."""
    cm = cut_lineage(classes.confusion(_ridge(spark, sf).withColumnRenamed("cage", "fold"), by=["fold"]), "confusion")
    hit = F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)) / F.sum("n")
    folds = classes.macro_f1(cm, by=["fold"]).join(cm.groupBy("fold").agg(hit.alias("accuracy")), "fold").withColumnRenamed("fold", "test_id")
    whole = cm.groupBy("true_label", "pred_label").agg(F.sum("n").alias("n"))
    pooled = classes.macro_f1(whole).crossJoin(F.broadcast(whole.agg(hit.alias("accuracy"))))  # one row each
    return rounded(classes.fold_summary(folds.select("test_id", "macro_f1", "accuracy"), pooled), "macro_f1", "accuracy")


def q_ridge_scores(spark, sf):
    cm = classes.confusion(_ridge(spark, sf).select("true_label", "pred_label"))
    return rounded(classes.class_scores(cm), "precision", "recall", "f1")


_N = 65  # features and the constant
# The normal equations of each fold, solved by elimination: step k clears column k in every other row.
_RIDGE = [
    ("e", f"""SELECT vec_id, substr({O.video('vec_id')}, 1, 2) AS cage, label, list_append(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 1.0::DOUBLE) AS x FROM embeddings"""),
    ("ij", f"SELECT i, j FROM (SELECT unnest(range(1, {_N + 1})) AS i), (SELECT unnest(range(1, {_N + 1})) AS j)"),
    ("g", "SELECT cage, label, i, j, sum(x[i] * x[j]) AS v FROM e CROSS JOIN ij GROUP BY ALL"),
    ("f", """SELECT c.cage AS fold, t.label, t.i, t.j, t.v - coalesce(g.v, 0) AS v FROM (SELECT DISTINCT cage FROM e) c
      CROSS JOIN (SELECT label, i, j, sum(v) AS v FROM g GROUP BY ALL) t LEFT JOIN g ON g.cage = c.cage AND g.label = t.label AND g.i = t.i AND g.j = t.j"""),
    ("cw", f"""SELECT fold, label, w * 10 / sum(w) OVER (PARTITION BY fold) AS w FROM (
      SELECT c.fold, l.label, 1 / sqrt(greatest(round(coalesce(f.v, 0)), 1)) AS w FROM (SELECT DISTINCT fold FROM f) c
      CROSS JOIN (SELECT unnest(range(10)) AS label) l LEFT JOIN f ON f.fold = c.fold AND f.label = l.label AND f.i = {_N} AND f.j = {_N})"""),
    ("aj", "SELECT fold, i, j AS k, sum(w * v) + (i = j)::INT AS v FROM f JOIN cw USING (fold, label) GROUP BY fold, i, j"),
    ("bj", f"SELECT cw.fold, f.i, {_N} + 1 + cw.label AS k, cw.w * f.v AS v FROM cw JOIN f USING (fold, label) WHERE f.j = {_N}"),
    ("full_row", f"""SELECT fold, i, list(coalesce(v, 0) ORDER BY k) AS r FROM (SELECT DISTINCT fold, i FROM aj)
      CROSS JOIN (SELECT unnest(range(1, {_N + 11})) AS k) LEFT JOIN (SELECT * FROM aj UNION ALL SELECT * FROM bj) USING (fold, i, k) GROUP BY ALL"""),
    ("st", f"""SELECT 0 AS s, fold, i, r FROM full_row UNION ALL
      SELECT st.s + 1, st.fold, st.i, CASE WHEN st.i = st.s + 1 THEN list_transform(st.r, lambda x: x / st.r[st.s + 1])
        ELSE list_transform(range(1, {_N + 11}), lambda k: st.r[k] - st.r[st.s + 1] / p.r[st.s + 1] * p.r[k]) END
      FROM st JOIN st p ON p.fold = st.fold AND p.i = st.s + 1 WHERE st.s < {_N}"""),
    ("model", f"SELECT fold, label, list(r[{_N} + 1 + label] ORDER BY i) AS w FROM st CROSS JOIN (SELECT unnest(range(10)) AS label) WHERE s = {_N} GROUP BY ALL"),
    ("p", """SELECT vec_id, cage AS lang, CAST(any_value(e.label) AS VARCHAR) AS true_label, CAST(max_by(m.label, list_dot_product(x, w)) AS VARCHAR) AS pred_label
      FROM e JOIN model m ON m.fold = e.cage GROUP BY vec_id, cage"""),
    ("names", "SELECT true_label AS c FROM p UNION SELECT pred_label FROM p"),
    ("cells", """SELECT l.lang, c, count(*) FILTER (WHERE true_label = c AND pred_label = c) AS tp, count(*) FILTER (WHERE true_label = c) AS support,
      count(*) FILTER (WHERE pred_label = c) AS predicted FROM (SELECT DISTINCT lang FROM p) l CROSS JOIN names JOIN p ON p.lang = l.lang GROUP BY ALL"""),
]
_F1 = "coalesce(2.0 * tp / nullif(support + predicted, 0), 0)"
SQL_RIDGE_FOLDS = (
    O._cte(
        *_RIDGE,
        ("fo", f"""SELECT lang AS test_id, avg({_F1}) AS macro_f1, any_value(acc) AS accuracy FROM cells
      JOIN (SELECT lang, avg((true_label = pred_label)::INT) AS acc FROM p GROUP BY ALL) USING (lang) GROUP BY ALL"""),
        ("po", f"""SELECT avg({_F1}) AS macro_f1, (SELECT avg((true_label = pred_label)::INT) FROM p) AS accuracy
      FROM (SELECT c, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM cells GROUP BY ALL)"""),
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + """SELECT test_id, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy FROM fo
    UNION ALL SELECT 'MEAN', round(avg(macro_f1), 6), round(avg(accuracy), 6) FROM fo
    UNION ALL SELECT 'STD', round(stddev_samp(macro_f1), 6), round(stddev_samp(accuracy), 6) FROM fo
    UNION ALL SELECT 'POOLED', round(macro_f1, 6), round(accuracy, 6) FROM po"""
)
SQL_RIDGE_SCORES = (
    O._cte(*_RIDGE).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"""SELECT c AS class, sum(tp)::BIGINT AS tp, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted,
    round(coalesce(sum(tp) / nullif(sum(predicted), 0), 0), 6) AS precision, round(coalesce(sum(tp) / nullif(sum(support), 0), 0), 6) AS recall,
    round(coalesce(2.0 * sum(tp) / nullif(sum(support) + sum(predicted), 0), 0), 6) AS f1 FROM cells GROUP BY c"""
)


# --- reports ----------------------------------------------------------------------------


def q_difficulty(spark, sf):
    metrics = cut_lineage(S.frame_metrics(spark, sf).drop("objects_present"), "frames")
    periods = events.occlusion_periods(metrics, window_frames=10, threshold=0.9, block=views.BLOCK)
    p = reports.difficulty_proxies(metrics, periods, views.videos(spark, sf))
    # Equal proxies must rank equal whatever the order of summation.
    return reports.difficulty_manifest(rounded(p, *reports.PROXIES, digits=9))


_PROX = ", ".join(f"rank() OVER (ORDER BY {c} {'ASC' if h else 'DESC'})" for c, h in reports.PROXIES.items()).replace("), rank", ") + rank")
SQL_DIFFICULTY = (
    S.SQL_OCCLUSION.replace("SELECT w.video_id, p.frame_idx", ", per AS (SELECT w.video_id, p.frame_idx", 1)
    + """), px AS (SELECT fm.video_id, round(avg(is_high_occlusion::INT), 9) AS frac_high_occlusion,
    round(avg(num_overlapping_pairs), 9) AS mean_overlapping_pairs, round(avg(mean_pairwise_bbox_iou), 9) AS mean_pairwise_bbox_iou,
    round(avg(is_object_count_change::INT), 9) AS frac_object_count_change,
    round(coalesce(avg(CASE WHEN mean_centroid_distance < 'inf'::DOUBLE THEN mean_centroid_distance END), 0), 9) AS mean_centroid_distance,
    round(avg(separation_score), 9) AS mean_separation_score,
    round(coalesce(any_value(np), 0) / (max(frame_idx) / 25.0::DOUBLE / 60), 9) AS num_occlusion_periods_per_min
    FROM fm LEFT JOIN (SELECT video_id, count(*) AS np FROM per GROUP BY ALL) USING (video_id) GROUP BY ALL),
    df AS (SELECT *, substr(video_id, 1, 2) AS cage, CAST("""
    + _PROX
    + """ AS INTEGER) AS difficulty FROM px),
    rk AS (SELECT *, CAST(rank() OVER (PARTITION BY cage ORDER BY difficulty DESC) AS INTEGER) AS rank_in_cage FROM df)
    SELECT *, rank_in_cage = 1 AS selected FROM rk"""
)


def q_group_shares(spark, sf):
    return rounded(reports.group_shares(views.labels(spark, sf), "behav_label", "behav"), "percent")


SQL_GROUP_SHARES = O.r6(
    O._cte(*D.LAB, ("n", "SELECT behav_label, behav, count(*) AS n FROM lab GROUP BY ALL"))
    + "SELECT behav_label, behav, n, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY behav_label) AS percent FROM n",
    "percent",
)


def q_day_shares(spark, sf):
    l = views.labels(spark, sf).withColumn("day", text.day_of("video_id"))
    names = ["none", "worm", "locomotor", "social"]
    return rounded(reports.pivot_shares(l, "day", "behav_label", names), *names)


SQL_DAY = O.r6(
    O._cte(*D.LAB)
    + "SELECT substr(video_id, 6, 2) AS day, "
    + ", ".join(f"count(*) FILTER (WHERE behav_label = '{c}') / count(*) AS {c}" for c in ("none", "worm", "locomotor", "social"))
    + " FROM lab GROUP BY ALL",
    "none",
    "worm",
    "locomotor",
    "social",
)


def q_window_scores(spark, sf):
    out = reports.window_score_stats(_windowed(spark, sf), ["video_id", "bird_id", "window"])
    return rounded(reports.width_bins(out, "mean_score", 10, "score_bin"), "mean_score", "min_score").drop("score_bin")


SQL_WINDOW_SCORES = O.r6(
    O._cte(O.DET, WDET)
    + """SELECT video_id, bird_id, "window", avg(tracker_score) AS mean_score, min(tracker_score) AS min_score, count(*) AS n_frames
    FROM wd GROUP BY ALL""",
    "mean_score",
    "min_score",
)


def q_width_bins(spark, sf):
    out = reports.width_bins(views.table(spark, sf, "events").select("event_id", "value"), "value", 10, "bin")
    return out.groupBy("bin").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


SQL_WIDTH = """SELECT CAST(least(greatest(ceil((value - a) / ((b - a) / 10)), 1), 10) AS INTEGER) AS bin, count(*) AS n,
    min(value) AS lo, max(value) AS hi FROM events CROSS JOIN (SELECT min(value) AS a, max(value) AS b FROM events) GROUP BY 1"""


def q_correlations(spark, sf):
    e = views.table(spark, sf, "events").withColumn("is_late", (F.col("user_id") % 2).cast("int"))
    return rounded(reports.correlations(e, "event_type", "value", "is_late"), "spearman", "point_biserial")


SQL_CORRELATIONS = O.r6(
    O._cte(
        ("e", "SELECT event_type, value, CAST(user_id % 2 AS DOUBLE) AS y FROM events"),
        (
            "r",
            """SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rx,
          rank() OVER (PARTITION BY event_type ORDER BY y) + (count(*) OVER (PARTITION BY event_type, y) - 1) / 2 AS ry FROM e""",
        ),
    )
    + "SELECT event_type, count(*) AS n, corr(rx, ry) AS spearman, corr(value, y) AS point_biserial FROM r GROUP BY event_type",
    "spearman",
    "point_biserial",
)


def _amounts(spark, sf):
    """99 of 100 orders share one value; the rest differ."""
    o = views.table(spark, sf, "orders")
    odd = F.when(F.col("o_orderkey") % 100 == 0, F.col("o_totalprice")).otherwise(F.lit(1.0))
    return o.select("o_orderpriority", odd.alias("amount"), "o_totalprice")


def q_correlations_tied(spark, sf):
    """Ranks where one value holds almost all rows."""
    return rounded(reports.correlations(_amounts(spark, sf), "o_orderpriority", "o_totalprice", "amount"), "spearman", "point_biserial")


SQL_CORRELATIONS_TIED = O.r6(
    O._cte(
        ("e", "SELECT o_orderpriority, o_totalprice AS value, CAST(CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice ELSE 1 END AS DOUBLE) AS y FROM orders"),
        (
            "r",
            """SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY value) + (count(*) OVER (PARTITION BY o_orderpriority, value) - 1) / 2 AS rx,
          rank() OVER (PARTITION BY o_orderpriority ORDER BY y) + (count(*) OVER (PARTITION BY o_orderpriority, y) - 1) / 2 AS ry FROM e""",
        ),
    )
    + "SELECT o_orderpriority, count(*) AS n, corr(rx, ry) AS spearman, corr(value, y) AS point_biserial FROM r GROUP BY o_orderpriority",
    "spearman",
    "point_biserial",
)


def q_column_quantiles(spark, sf):
    li = views.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    return rounded(distributions.quantiles(li, li.columns, [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]), "value")


SQL_COLUMN_QUANTILES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", p, round(v, 6) AS value FROM (
      SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.9, 1.0]::DOUBLE[]) AS p, unnest(quantile_cont({c}::DOUBLE, [0.0, 0.01, 0.25, 0.5, 0.9, 1.0])) AS v FROM lineitem)"""
    for c in ("l_quantity", "l_extendedprice", "l_discount")
)


def q_importance(spark, sf):
    """Order amounts as a long attribution table: priority = class, status and customer = column."""
    o = views.table(spark, sf, "orders")
    col = F.concat(
        F.when(F.col("o_orderstatus") == "O", "velocity_autocorr").when(F.col("o_orderstatus") == "F", "velocity").otherwise("solidity"),
        F.lit("_"),
        F.get(F.array(F.lit("mean"), F.lit("std"), F.lit("q10")), (F.col("o_custkey") % 3).cast("int")),
    )
    a = o.select(F.col("o_orderpriority").alias("class"), col.alias("column"), (F.col("o_totalprice") - 200000).alias("value"))
    out = reports.importance(a, suffixes=["mean", "std", "q10"], families={"velocity_autocorr": "velocity"})
    return rounded(out, "importance", "feature_mean", digits=4)


SQL_IMPORTANCE = O.r6(
    O._cte(
        (
            "a",
            """SELECT o_orderpriority AS class, CASE o_orderstatus WHEN 'O' THEN 'velocity_autocorr' WHEN 'F' THEN 'velocity' ELSE 'solidity' END AS b,
          ['mean', 'std', 'q10'][o_custkey % 3 + 1] AS s, o_totalprice - 200000 AS v FROM orders""",
        ),
        (
            "i",
            """SELECT CASE WHEN b LIKE 'velocity%' THEN 'velocity' ELSE b END AS feature, class, b || '_' || s AS "column", avg(abs(v)) AS importance
          FROM a GROUP BY ALL""",
        ),
    )
    + 'SELECT *, avg(importance) OVER (PARTITION BY feature) AS feature_mean FROM i',
    "importance",
    "feature_mean",
    digits=4,
)


def q_purity(spark, sf):
    e = _emb(spark, sf)
    nn = reports.nearest_neighbour(e, key="vec_id", vec="embedding", pivots=16, slice_rows=64, query_rows=256)
    out = reports.purity(e, nn, key="vec_id", label="label").withColumn("class", F.col("class").cast("int"))
    return rounded(out, "purity", "chance", "lift")


SQL_PURITY = O.r6(
    """WITH nn AS (SELECT k, any_value(l) AS l, arg_max(o, s) AS o FROM (SELECT a.vec_id AS k, a.label AS l, b.label AS o,
      list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) GROUP BY k)
    SELECT CAST(l AS INTEGER) AS class, count(*) AS n, avg(CASE WHEN l = o THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS purity, count(*) / (SELECT count(*) FROM nn) AS chance,
    avg(CASE WHEN l = o THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / (count(*) / (SELECT count(*) FROM nn)) AS lift FROM nn GROUP BY l""",
    "purity",
    "chance",
    "lift",
)


def q_cka(spark, sf):
    e = _emb(spark, sf).select(
        F.slice("embedding", 1, 32).alias("x"),
        F.slice("embedding", 33, 32).alias("y"),
    )
    return rounded(reports.linear_cka(e, "x", "y"), "cka")


SQL_CKA = O.r6(
    O._cte(
        ("m", "SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS mu FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i"),
        ("mv", "SELECT list(mu ORDER BY i) AS mu FROM m"),
        ("c", "SELECT vec_id, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) - mu[i]) AS v FROM embeddings CROSS JOIN mv"),
        (
            "k",
            """SELECT list_inner_product(a.v[1:32], b.v[1:32]) AS k, list_inner_product(a.v[33:64], b.v[33:64]) AS l
          FROM c a JOIN c b ON a.vec_id <> b.vec_id""",
        ),
    )
    + "SELECT sum(k * l) / sqrt(sum(k * k) * sum(l * l)) AS cka FROM k",
    "cka",
)


def q_integrity(spark, sf):
    t, l = D.complete(spark, sf)
    return reports.integrity(t, l, frames_per_window=12, low=8, high=25)


SQL_INTEGRITY = (
    O._cte(
        *D.WIN,
        ("s", 'SELECT video_id, bird_id, "window", count(*) AS n FROM ktr GROUP BY ALL'),
        ("lw", 'SELECT DISTINCT video_id, bird_id, "window" FROM klab'),
    )
    + """SELECT 'window_not_too_long' AS expectation, count(*) FILTER (WHERE n > 25) AS n_bad FROM s
    UNION ALL SELECT 'window_not_too_short', count(*) FILTER (WHERE n < 8) FROM s
    UNION ALL SELECT 'nine_in_ten_windows_exact', CASE WHEN count(*) FILTER (WHERE n <> 12) > 0.1 * count(*) THEN count(*) FILTER (WHERE n <> 12) ELSE 0 END FROM s
    UNION ALL SELECT 'no_duplicate_rows', count(*) FILTER (WHERE n > 1) FROM (SELECT count(*) AS n FROM ktr GROUP BY video_id, bird_id, frame_idx)
    UNION ALL SELECT 'bird_in_one_cage', count(*) FILTER (WHERE n > 1) FROM (SELECT count(DISTINCT substr(video_id, 1, 2)) AS n FROM ktr GROUP BY bird_id)
    UNION ALL SELECT 'windows_have_labels', count(*) FROM s ANTI JOIN lw USING (video_id, bird_id, "window")
    UNION ALL SELECT 'labels_have_windows', count(*) FROM lw ANTI JOIN s USING (video_id, bird_id, "window")"""
)


def q_conversation_runs(spark, sf):
    """Gaps and islands on conversation turns per role."""
    from trackspark.operators import blocks

    c = views.table(spark, sf, "conversations")
    out = blocks.runs(c, ["conv_id", "role"], "turn", block=4)
    return out


SQL_CONV = O._cte(("runs", O.islands("conversations", "conv_id, role", "turn", "1"))) + "SELECT * FROM runs"

QUERIES = {
    "segment_pool": (q_segment_pool, SQL_POOL),
    "segment_pool_zscored": (q_segment_pool_z, SQL_POOL_Z),
    "mean_pool": (q_mean_pool, SQL_MEAN_POOL),
    "concat_embeddings": (q_concat_embeddings, SQL_CONCAT),
    "scale_columns": (q_scale_columns, SQL_SCALE),
    "even_rows": (q_even_rows, SQL_EVEN),
    "clip_plan": (q_clip_plan, SQL_CLIPS),
    "crop_plan": (q_crop_plan, SQL_CROP),
    "cage_folds": (q_cage_folds, SQL_CAGE_FOLDS),
    "video_folds": (q_video_folds, SQL_VIDEO_FOLDS),
    "shuffled_folds": (q_shuffled_folds, SQL_SHUFFLED),
    "split_counts": (q_split_counts, SQL_SPLITS),
    "class_weights": (q_class_weights, SQL_WEIGHTS),
    "confusion": (q_confusion, SQL_CONFUSION),
    "class_scores": (q_class_scores, SQL_SCORES),
    "smoothed_scores": (q_smoothed_scores, SQL_SMOOTHED),
    "normalised_confusion": (q_normalised_confusion, SQL_NORMALISED),
    "fold_summary": (q_fold_summary, SQL_FOLD_SUMMARY),
    "subset_scores": (q_subset_scores, SQL_SUBSETS),
    "recall_by_quartile": (q_recall_by_quartile, SQL_QUARTILE),
    "recall_main_confusion": (q_main_confusion, SQL_MAIN_CONFUSION),
    "linear_baseline": (q_linear_baseline, None),
    "ridge_folds": (q_ridge_folds, SQL_RIDGE_FOLDS),
    "ridge_scores": (q_ridge_scores, SQL_RIDGE_SCORES),
    "difficulty_manifest": (q_difficulty, SQL_DIFFICULTY),
    "group_shares": (q_group_shares, SQL_GROUP_SHARES),
    "day_shares": (q_day_shares, SQL_DAY),
    "window_scores": (q_window_scores, SQL_WINDOW_SCORES),
    "width_bins": (q_width_bins, SQL_WIDTH),
    "correlations": (q_correlations, SQL_CORRELATIONS),
    "correlations_tied": (q_correlations_tied, SQL_CORRELATIONS_TIED),
    "column_quantiles": (q_column_quantiles, SQL_COLUMN_QUANTILES),
    "importance": (q_importance, SQL_IMPORTANCE),
    "neighbour_purity": (q_purity, SQL_PURITY),
    "linear_cka": (q_cka, SQL_CKA),
    "integrity_report": (q_integrity, SQL_INTEGRITY),
    "conversation_runs": (q_conversation_runs, SQL_CONV),
}

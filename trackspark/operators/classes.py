"""Cross-validation folds, class metrics and baseline classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.text import cage_of
from trackspark.session import cut_lineage

# --- labels as codes --------------------------------------------------------------------


def encode(label: str, order: Sequence[str]) -> Column:
    """Position of a label in a fixed class order; NULL for an unknown one."""
    pos = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(label))
    return F.when(pos > 0, (pos - 1).cast("int"))


def decode(code: str, order: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in order]), F.col(code))


def exclude(df: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    return df.filter(~F.col(label).isin(list(names)))


# --- folds ------------------------------------------------------------------------------


def cage_folds(videos: DataFrame) -> DataFrame:
    """Leave one cage out: (test_id, val_id), validation = next cage, circular.

    The windows below run over the distinct cages / videos: a table of ids, not of rows.
    """
    cages = videos.select(cage_of("video_id").alias("test_id")).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("test_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = F.coalesce(F.lead("test_id").over(w), F.first("test_id").over(whole))
    out = cages.withColumns({"val_id": nxt, "_n": F.count(F.lit(1)).over(whole)})
    few = F.raise_error(F.lit("leave-one-cage-out needs at least 2 cages"))
    return out.withColumn("val_id", F.when(F.col("_n") < 2, few).otherwise(F.col("val_id"))).drop("_n")


def video_folds(videos: DataFrame) -> DataFrame:
    """Leave one video out: validation = same position (modulo) in the next cage."""
    w = Window.partitionBy("cage").orderBy("video_id")
    v = videos.select("video_id").distinct().withColumn("cage", cage_of("video_id"))
    v = v.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("cage"))})
    nxt = cage_folds(videos).select(F.col("test_id").alias("cage"), F.col("val_id").alias("next_cage"))
    target = v.select(F.col("cage").alias("next_cage"), F.col("i").alias("_j"), F.col("video_id").alias("val_id"))
    size = v.select(F.col("cage").alias("next_cage"), F.col("n").alias("_m")).distinct()
    j = v.join(nxt, "cage").join(size, "next_cage").withColumn("_j", F.col("i") % F.col("_m"))
    return j.join(target, ["next_cage", "_j"]).select(F.col("video_id").alias("test_id"), "val_id")


def shuffled_folds(videos: DataFrame, seed: int, *, by: str = "cage") -> DataFrame:
    """Seeded random validation ids from other cages, the same on every run.

    The ids (cages or videos) stand on a circle in the order of a hash; each takes the first one
    after it from another cage: the start of the next stretch of one cage.
    """
    unit = cage_of("video_id") if by == "cage" else F.col("video_id")
    ids = videos.select(unit.alias("test_id")).distinct().withColumn("cage", cage_of("test_id"))
    ids = ids.withColumn("h", F.md5(F.concat_ws("/", "test_id", F.lit(str(seed)))))
    line = Window.partitionBy(F.lit(0)).orderBy("h", "test_id")  # a table of ids, not of rows
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    opens = F.coalesce((F.lag("cage").over(line) != F.col("cage")).cast("int"), F.lit(1))
    ids = ids.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(line))
    ids = ids.withColumns({"last": F.max("stretch").over(whole), "last_cage": F.last("cage").over(whole)})
    heads = ids.filter("opens = 1").select(F.col("stretch").alias("after"), F.col("test_id").alias("val_id"), F.col("cage").alias("val_cage"))
    # Past the end the circle goes on with the first stretch, or the second if the first goes on with the last.
    first_cage = F.first("cage").over(whole)
    after = F.when(F.col("stretch") < F.col("last"), F.col("stretch") + 1).when(first_cage != F.col("last_cage"), F.lit(1)).otherwise(F.lit(2))
    few = F.raise_error(F.lit("shuffled folds need at least 2 cages"))
    after = F.when(F.col("last") < 2, few.cast("long")).otherwise(after)
    return ids.withColumn("after", after).join(heads, "after").select("test_id", "val_id")


def tag_splits(rows: DataFrame, folds: DataFrame, *, group: Column | None = None) -> DataFrame:
    """Every row once per fold with split 'test', 'val' or 'train'."""
    g = cage_of("video_id") if group is None else group
    split = (
        F.when(g == F.col("test_id"), F.lit("test"))
        .when(g == F.col("val_id"), F.lit("val"))
        .otherwise(F.lit("train"))
    )
    return rows.crossJoin(F.broadcast(folds)).withColumn("split", split)  # folds: one row per cage


def class_weights(rows: DataFrame, label: str, order: Sequence[str], *, scheme: str = "inv-sqrt") -> DataFrame:
    """(class, n, weight): inverse (root) counts, clamped to 1, scaled to sum to the class count."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(c, i) for i, c in enumerate(order)], "class string, idx int")
    n = rows.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(n, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    c = F.greatest(F.col("n"), F.lit(1)).cast("double")
    raw = {"inv": 1 / c, "inv-sqrt": 1 / F.sqrt(c), "none": F.lit(1.0)}[scheme]
    total = F.sum("_w").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("_w", raw).select("class", "n", (F.col("_w") / total * len(order)).alias("weight"))


# --- class metrics ----------------------------------------------------------------------


def confusion(pred: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (by, true_label, pred_label), zeros included for every combination of seen classes."""
    n = pred.groupBy(*by, "true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    # Class names only: a handful of rows, taken from the counted table.
    names = n.select(F.explode(F.array("true_label", "pred_label")).alias("c")).distinct()
    grid = names.select(F.col("c").alias("true_label")).crossJoin(F.broadcast(names.select(F.col("c").alias("pred_label"))))
    if by:
        grid = n.select(*by).distinct().crossJoin(F.broadcast(grid))
    return grid.join(n, [*by, "true_label", "pred_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def class_scores(cm: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table."""
    hit = F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(F.lit(0)))
    rows = cm.groupBy(*by, F.col("true_label").alias("class")).agg(hit.alias("tp"), F.sum("n").alias("support"))
    cols = cm.groupBy(*by, F.col("pred_label").alias("class")).agg(F.sum("n").alias("predicted"))
    out = rows.join(cols, [*by, "class"], "full").fillna(0, ["tp", "support", "predicted"])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    out = out.withColumns({"precision": p, "recall": r})
    s = F.col("precision") + F.col("recall")
    f1 = F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1)


def smoothed_scores(cm: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Class scores with denominators clipped to 1 and a small constant in the F1."""
    s = class_scores(cm, by=by)
    p = F.col("tp") / F.greatest("predicted", F.lit(1))
    r = F.col("tp") / F.greatest("support", F.lit(1))
    return s.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-8))
    )


def macro_f1(cm: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return class_scores(cm, by=by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def normalised_confusion(cm: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Row shares with the class's precision, F1 and support alongside."""
    total = F.sum("n").over(Window.partitionBy(*by, "true_label"))
    share = F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0))
    marg = class_scores(cm, by=by).select(*by, F.col("class").alias("true_label"), "precision", "f1", "support")
    return cm.withColumn("share", share).join(marg, [*by, "true_label"])


def fold_summary(folds: DataFrame, pooled: DataFrame | None = None, *, first: str = "test_id") -> DataFrame:
    """Fold rows followed by MEAN, STD (sample) and, when given, POOLED rows."""
    numeric = [f.name for f in folds.schema if f.dataType.typeName() in ("double", "float", "integer", "long")]
    texts = [c for c in folds.columns if c not in numeric]

    def line(name: str, fn) -> DataFrame:
        agg = folds.agg(*[fn(F.col(c).cast("double")).alias(c) for c in numeric])
        return agg.withColumns({c: F.lit(name if c == first else "") for c in texts}).select(*folds.columns)

    out = folds.withColumns({c: F.col(c).cast("double") for c in numeric})
    out = out.unionByName(line("MEAN", F.avg)).unionByName(line("STD", F.stddev_samp))
    if pooled is not None:
        have = set(pooled.columns)
        row = pooled.select(
            *[
                (F.col(c).cast("double") if c in have else F.lit(None).cast("double")).alias(c)
                if c in numeric
                else F.lit("POOLED" if c == first else "").alias(c)
                for c in folds.columns
            ]
        )
        out = out.unionByName(row)
    return out


def subset_scores(pred: DataFrame, subsets: Column) -> DataFrame:
    """Class scores on overlapping subsets: ``subsets`` gives each row's array of subset names."""
    tagged = pred.withColumn("subset", F.explode(subsets))
    return class_scores(confusion(tagged, by=["subset"]), by=["subset"])


def recall_with_main_confusion(pred: DataFrame, *, sub: str, min_rows: int = 5) -> DataFrame:
    """Per (true_label, sub-class) with enough rows: recall and the most frequent wrong class."""
    keys = ["true_label", sub]
    n = pred.groupBy(*keys, "pred_label").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(F.lit(0))).alias("hits"),
    )
    wrong = n.filter(F.col("true_label") != F.col("pred_label")).groupBy(*keys).agg(
        F.min(F.struct((-F.col("n")).alias("neg"), "pred_label")).alias("w")
    )
    out = total.filter(F.col("n") >= min_rows).join(wrong, keys, "left")
    return out.select(
        *keys,
        "n",
        (F.col("hits") / F.col("n")).alias("recall"),
        F.col("w.pred_label").alias("confused_with"),
        (-F.col("w.neg") / F.col("n")).alias("confused_share"),
    )


# --- baselines --------------------------------------------------------------------------


def fit_predict(
    train: DataFrame,
    test: DataFrame,
    *,
    features: str = "features",
    label: str = "label",
    weight: str | None = "weight",
    model: str = "linear",
    classes: int = 2,
    seed: int = 0,
) -> DataFrame:
    """Fit a baseline on ``train`` and add ``prediction`` to ``test``.

    ``linear``: multinomial logistic regression; ``trees``: one-vs-rest boosted trees; ``mlp``:
    a small perceptron (takes no weights). ``features`` is an array column.
    """
    from pyspark.ml.classification import (
        GBTClassifier,
        LogisticRegression,
        MultilayerPerceptronClassifier,
        OneVsRest,
    )
    from pyspark.ml.functions import array_to_vector

    def vec(df):
        return df.withColumn("_x", array_to_vector(F.col(features)))

    common = {"featuresCol": "_x", "labelCol": label}
    w = {"weightCol": weight} if weight else {}
    if model == "linear":
        est = LogisticRegression(family="multinomial", maxIter=50, regParam=0.01, **common, **w)
    elif model == "trees":
        est = OneVsRest(classifier=GBTClassifier(maxIter=10, maxDepth=4, seed=seed, **common), **common, **w)
    else:
        width = len(train.select(features).first()[0])
        est = MultilayerPerceptronClassifier(layers=[width, 64, classes], seed=seed, maxIter=50, **common)
    fitted = est.fit(vec(train))
    return fitted.transform(vec(test)).drop("_x", "rawPrediction", "probability")


#: Groups and classes whose sums a task holds before it sends them on.
MOST_SUMS = 1000


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(group, class, features)``: for each (group, class) the sums of products of two features."""
    names = ["group", "class", "sums"]
    sums: dict[tuple, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        columns = [[g for g, _ in sums], [c for _, c in sums], [s[np.triu_indices(len(s))] for s in sums.values()]]
        kinds = [pa.string(), pa.string(), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column(2)
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
        x = np.concatenate([x, np.ones((len(x), 1))], 1)  # the last feature is constant
        owner: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            owner.setdefault(key, []).append(k)
        for key, rows in owner.items():
            part = x[rows]
            product = part.T @ part
            sums[key] = sums[key] + product if key in sums else product
        if len(sums) > MOST_SUMS:
            yield out()
            sums.clear()
    if sums:
        yield out()


def ridge_folds(
    rows: DataFrame, order: Sequence[str], *, group: Column | str, label: str = "label", features: str = "features", penalty: float = 1.0
) -> DataFrame:
    """Leave one group out with a ridge classifier: adds ``test_id`` and ``prediction`` (a class name) to every row.

    One scan sums the products of features of each (group, class). A fold's normal equations are all
    sums less those of its group, with the classes weighted by the inverse root of their counts in the
    fold, so no fold reads the rows again. Rows of unknown classes or groups teach nothing and those of no
    group are dropped; the first class of ``order`` wins ties; all feature arrays have one length.
    """
    rows = rows.withColumn("test_id", F.col(group) if isinstance(group, str) else group).filter("test_id is not null")
    known = rows.filter(F.col(label).isin(list(order)) & F.col(features).isNotNull())
    parts = known.select("test_id", F.col(label), F.col(features).cast("array<double>")).mapInArrow(_products, "test_id string, class string, sums array<double>")
    sums = parts.select("test_id", "class", F.posexplode("sums").alias("pos", "value")).groupBy("test_id", "class", "pos").agg(F.sum("value").alias("value"))
    sums = cut_lineage(sums, "products")
    total = sums.groupBy("class", "pos").agg(F.sum("value").alias("total"))
    # A fold needs all its equations: one row for each fold, class and pair of features.
    folds = sums.select("test_id").distinct().join(total).join(sums, ["test_id", "class", "pos"], "left")
    folds = folds.select("test_id", "class", "pos", (F.col("total") - F.coalesce("value", F.lit(0.0))).alias("value"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int((np.sqrt(8 * (pdf["pos"].max() + 1) + 1) - 1) / 2)
        upper = np.triu_indices(size)
        grams = []
        for name in order:
            g = np.zeros((size, size))
            mine = pdf[pdf["class"] == name]
            g[upper[0][mine["pos"]], upper[1][mine["pos"]]] = mine["value"]
            grams.append(g + np.triu(g, 1).T)
        weight = np.array([1 / np.sqrt(max(round(g[-1, -1]), 1)) for g in grams])
        weight *= len(order) / weight.sum()
        left = sum(w * g for w, g in zip(weight, grams)) + penalty * np.eye(size)
        right = np.stack([w * g[:, -1] for w, g in zip(weight, grams)], 1)
        return pd.DataFrame({"test_id": [pdf["test_id"].iloc[0]], "model": [np.linalg.solve(left, right).T.tolist()]})

    models = folds.groupBy("test_id").applyInPandas(solve, "test_id string, model array<array<double>>")
    x = F.concat(F.col(features).cast("array<double>"), F.array(F.lit(1.0)))
    score = lambda w: F.aggregate(F.zip_with(w, F.col("_x"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = rows.withColumn("_x", x).join(models, "test_id").withColumn("_s", F.transform("model", score))
    best = F.array_position("_s", F.array_max("_s")).cast("int")
    return scored.withColumn("prediction", F.get(F.array(*[F.lit(c) for c in order]), best - 1)).drop("_x", "_s", "model")

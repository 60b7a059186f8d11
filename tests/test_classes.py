import pytest
from pyspark.sql import functions as F

from trackspark.operators import classes, reports

# A published leave-one-cage-out summary (test, train, val macro F1 per fold).
FOLDS = [
    ("C1", "C2", 0.6575914836080735, 0.9110975260003924, 0.7306114284285852),
    ("C2", "C3", 0.72717887668587, 0.9130599867248916, 0.7526687102002586),
    ("C3", "C4", 0.7555593492134131, 0.8933391323454308, 0.765828574887191),
    ("C4", "C5", 0.7640474622631167, 0.8874314779921274, 0.7767555940635161),
    ("C5", "C1", 0.7796466274469585, 0.896536024417677, 0.6447592166543737),
]


@pytest.fixture(scope="module")
def fifteen(spark):
    return spark.createDataFrame([(f"C{c}G{g}D28",) for c in range(1, 6) for g in range(1, 4)], "video_id string")


def test_fold_rotation(fifteen):
    assert {tuple(r) for r in classes.cage_folds(fifteen).collect()} == {f[:2] for f in FOLDS}
    v = dict(tuple(r) for r in classes.video_folds(fifteen).collect())
    assert len(v) == 15 and v["C1G2D28"] == "C2G2D28" and v["C5G3D28"] == "C1G3D28"
    s = dict(tuple(r) for r in classes.shuffled_folds(fifteen, 3, by="video").collect())
    assert len(s) == 15 and all(a[:2] != b[:2] for a, b in s.items())


def test_fold_needs_two_cages(spark):
    with pytest.raises(Exception, match="at least 2 cages"):
        classes.cage_folds(spark.createDataFrame([("C1G1D28",)], "video_id string")).collect()


def test_published_summary(spark):
    df = spark.createDataFrame(FOLDS, "test_id string, val_id string, test double, train double, val double")
    rows = {r["test_id"]: r for r in classes.fold_summary(df).collect()}
    assert rows["MEAN"]["test"] == pytest.approx(0.7368047598434864)
    assert rows["STD"]["test"] == pytest.approx(0.0482097651825448)
    assert rows["STD"]["val"] == pytest.approx(0.0528321441372496) and rows["MEAN"]["val_id"] == ""


def test_codes_and_weights(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] + [("z",)], "c string")
    order = ["b", "a", "q"]
    got = df.select("c", classes.encode("c", order).alias("i")).withColumn("back", classes.decode("i", order)).distinct()
    assert {tuple(r) for r in got.collect()} == {("a", 1, "a"), ("b", 0, "b"), ("z", None, None)}
    w = {r["class"]: r["weight"] for r in classes.class_weights(df, "c", order).collect()}
    assert sum(w.values()) == pytest.approx(3) and w["a"] == pytest.approx(w["b"] / 2) and w["q"] == w["b"]


def test_baselines_learn(spark):
    rows = [([float(i % 3) + 0.01 * (i % 7), float(-(i % 3)), 1.0 if i % 3 == 1 else 0.0], float(i % 3), 1.0) for i in range(180)]
    df = spark.createDataFrame(rows, "features array<double>, label double, weight double")
    for model in ("linear", "trees", "mlp"):
        out = classes.fit_predict(df, df, model=model, classes=3)
        assert out.filter(F.col("prediction") == F.col("label")).count() >= 170, model


def test_difficulty_ranks_ties_low(spark):
    names = list(reports.PROXIES)
    rows = [("C1G1D28", *[1.0] * 7), ("C1G2D28", *[1.0] * 7), ("C2G1D29", *[2.0] * 5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "video_id string, " + ", ".join(f"{c} double" for c in names))
    got = {r["video_id"]: (r["difficulty"], r["rank_in_cage"], r["selected"]) for r in reports.difficulty_manifest(df).collect()}
    assert got == {"C1G1D28": (7, 1, True), "C1G2D28": (7, 1, True), "C2G1D29": (21, 1, True)}
    with pytest.raises(ValueError):
        reports.require_selected(reports.difficulty_manifest(df), "29", 2)


def test_ridge_folds_against_refitting(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    n, d, order = 240, 5, ["a", "b", "c"]
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, d)) + 1.5 * np.eye(3, d)[y]
    g = rng.choice(["C1", "C2", "C3"], n, p=[0.6, 0.3, 0.1])
    rows = [(str(gi), order[yi], xi.tolist()) for gi, yi, xi in zip(g, y, x)]
    odd = [("C1", "unknown", [0.0] * d), (None, "a", [1.0] * d), ("C2", None, [2.0] * d)]
    df = spark.createDataFrame(rows + odd, "cage string, label string, features array<double>").repartition(4)
    old, classes.MOST_SUMS = classes.MOST_SUMS, 2
    try:
        got = classes.ridge_folds(df, order, group="cage", penalty=0.5).collect()
    finally:
        classes.MOST_SUMS = old
    assert len(got) == n + 2
    full = np.concatenate([x, np.ones((n, 1))], 1)
    for cage in ("C1", "C2", "C3"):
        train = g != cage
        w = 1 / np.sqrt(np.maximum(np.bincount(y[train], minlength=3), 1))
        w *= 3 / w.sum()
        weighted = full[train] * w[y[train]][:, None]
        coef = np.linalg.solve(weighted.T @ full[train] + 0.5 * np.eye(d + 1), weighted.T @ np.eye(3)[y[train]])
        want = {tuple(v): order[k] for v, k in zip(x[~train].tolist(), (full[~train] @ coef).argmax(1))}
        mine = {tuple(r["features"]): r["prediction"] for r in got if r["test_id"] == cage and r["label"] in order}
        assert mine == want and len(want) > 10

"""Quantiles, ranks and rank correlations by ranges, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackspark.operators import distributions as D
from trackspark.operators import reports, sequences

PROBS = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 4000
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), n), "smooth": rng.normal(size=n), "few": rng.integers(0, 3, n).astype(float)})
    pdf["tied"] = np.where(rng.random(n) < 0.99, 1.0, rng.normal(size=n))
    pdf["gaps"] = np.where(rng.random(n) < 0.3, None, pdf["smooth"]).astype(object)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "g string, smooth double, few double, tied double, gaps double")
    return pdf, df.repartition(5)


def test_quantiles_against_numpy(table):
    pdf, df = table
    names = ["smooth", "few", "tied", "gaps"]
    got = {(r["column"], r["p"]): r["value"] for r in D.quantiles(df, names, PROBS).collect()}
    for c in names:
        want = np.quantile(pdf[c].dropna().astype(float), PROBS)
        assert np.allclose([got[c, p] for p in PROBS], want)


def test_quantiles_of_little(spark):
    one = spark.createDataFrame([(3.0, None), (None, None)], "a double, b double")
    got = {(r["column"], r["p"]): r["value"] for r in D.quantiles(one, ["a", "b"], [0.0, 0.3]).collect()}
    assert got == {("a", 0.0): 3.0, ("a", 0.3): 3.0, ("b", 0.0): None, ("b", 0.3): None}
    assert sequences.scale_columns(one, ["a"]).count() == 2


@pytest.mark.parametrize("parts", [2, 40])
def test_ranks_over_partitions(table, spark, parts):
    """With many small ranges the shared value goes on over most of them."""
    pdf, df = table
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = df.groupBy("g", "tied", "smooth").agg(F.count("*").alias("n"))
        rows = D.average_ranks(counts, ["g"], "tied", "n", "r", tie=["smooth"]).collect()
        got = {(r["g"], r["tied"]): r["r"] for r in rows}
        assert len(rows) == len(pdf.drop_duplicates(["g", "tied", "smooth"]))
        out = {r["g"]: r for r in reports.correlations(df, "g", "smooth", "tied").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    pdf = pdf.assign(r=pdf.groupby("g")["tied"].rank())
    want = {(g, t): r for g, t, r in zip(pdf["g"], pdf["tied"], pdf["r"])}
    assert got == want
    for g, part in pdf.groupby("g"):
        assert out[g]["n"] == len(part)
        assert np.isclose(out[g]["spearman"], part["smooth"].rank().corr(part["tied"].rank()))
        assert np.isclose(out[g]["point_biserial"], part["smooth"].corr(part["tied"]))


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 3.0), ("b", None, 3.0)], "g string, x double, y double")
    got = {r["g"]: (r["n"], r["spearman"]) for r in reports.correlations(df, "g", "x", "y").collect()}
    assert got["a"] == (2, None) and got["b"][0] == 2 and np.isclose(got["b"][1], 1.0)


def test_quartile_bins(table):
    pdf, df = table
    got = reports.quantile_bins(df, "few", 4, "q").groupBy("few").agg(F.min("q").alias("a"), F.max("q").alias("b")).collect()
    edges = np.quantile(pdf["few"], [0.25, 0.5, 0.75])
    assert all(r["a"] == r["b"] == 1 + sum(r["few"] > e for e in edges) for r in got)


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_nearest_neighbours_against_all_pairs(spark, spread):
    """Clusters of very different size: exact, and with clusters most slices are never asked."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 8))
    at = rng.choice(12, 900, p=[0.45] + [0.05] * 11)
    x = centre[at] + spread * rng.normal(size=(900, 8))
    x[100] = x[101] = x[7]  # ties go to the lowest key
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, e array<double>").repartition(4)
    got = {r["id"]: (r["neighbour"], r["similarity"]) for r in reports.nearest_neighbour(df, key="id", vec="e", pivots=12, slice_rows=50, query_rows=200).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    np.fill_diagonal(sim, -np.inf)
    assert len(got) == 900
    for k in range(900):
        assert np.isclose(got[k][1], sim[k].max(), atol=1e-11) and sim[k, got[k][0]] >= sim[k].max() - 1e-11
    assert got[7][0] == 100 and got[100][0] == got[101][0] == 7
    if spread < 1:
        _, _, asks, n = reports.neighbour_asks(df, key="id", vec="e", pivots=12, slice_rows=50)
        assert asks.count() < 0.5 * 900 * (n - 1)
    assert reports.nearest_neighbour(df.limit(0), key="id", vec="e").count() == 0
    assert reports.nearest_neighbour(df.limit(1), key="id", vec="e").count() == 0


def test_nearest_neighbours_shuffle_no_vectors_twice(spark):
    """Was a copy of every member for each stretch of queries: vectors without clusters filled the disk."""
    x = np.random.default_rng(6).normal(size=(600, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, e array<double>")
    nn = reports.nearest_neighbour(df, key="id", vec="e", pivots=4, slice_rows=20, query_rows=50)
    plan = nn._jdf.queryExecution().executedPlan().toString()
    # The exchange of the answers alone.
    assert nn.count() == 600 and plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" in plan


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_nearest_neighbours_across_bundles(spark, spread, monkeypatch):
    """Every two slices were a row with both of their vectors: 32 times as many bytes as bundles of slices need."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12, 8))[rng.integers(0, 12, 700)] + spread * rng.normal(size=(700, 8))
    x[300] = x[301] = x[5]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, e array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    np.fill_diagonal(sim, -np.inf)
    for rows in (64, 4096):
        monkeypatch.setattr(reports, "BUNDLE_ROWS", rows)
        members, _, numbers = reports._dealt(df, "id", "e", 12, 16)
        bundles = members.select("b").distinct().count()
        assert bundles == (-(-numbers.sum() // 4) if rows == 64 else 1)
        got = {r["id"]: (r["neighbour"], r["similarity"]) for r in reports.nearest_neighbour(df, key="id", vec="e", pivots=12, slice_rows=16).collect()}
        assert len(got) == 700
        for k in range(700):
            assert np.isclose(got[k][1], sim[k].max(), atol=1e-11) and sim[k, got[k][0]] >= sim[k].max() - 1e-11
        assert got[5][0] == 300 and got[300][0] == got[301][0] == 5

"""Blocked sequence operators equal plain windows for every block size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.operators import blocks as B

W = Window.partitionBy("v").orderBy("f")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    frames = sorted(rng.sample(range(2000), 900))
    data = [(f"v{rng.randint(0, 2)}", f, rng.random() < 0.3) for f in frames]
    return spark.createDataFrame(data, "v string, f int, g boolean").cache()


def same(a, b):
    a = a.select(*b.columns)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("block", [7, 64, 10**6])
def test_neighbours(rows, block):
    nb = B.Neighbours(rows, ["v"], "f", back=5, ahead=24, block=block)
    total, n = nb.sum_ahead("g", 25)
    got = nb.with_columns(
        {
            "p1": nb.lag("f"),
            "p2": nb.lag("f", 2),
            "n3": nb.lead("f", 3),
            "s": total,
            "n": n,
            "a": nb.any_behind("g", 5),
        }
    )
    ahead, behind = W.rowsBetween(0, 24), W.rowsBetween(-5, -1)
    want = rows.withColumns(
        {
            "p1": F.lag("f").over(W),
            "p2": F.lag("f", 2).over(W),
            "n3": F.lead("f", 3).over(W),
            "s": F.sum(F.col("g").cast("long")).over(ahead),
            "n": F.count("*").over(ahead),
            "a": F.coalesce(F.max("g").over(behind), F.lit(False)),
        }
    )
    same(got, want)
    one = B.Neighbours(rows, ["v"], "f", back=1, block=block)
    same(one.with_columns({"p1": one.lag("f")}), want.select("v", "f", "g", "p1"))


@pytest.mark.parametrize("block", [7, 100])
def test_runs_and_prefixes(rows, block):
    brk = F.coalesce((F.col("f") - F.lag("f").over(W) > 2).cast("int"), F.lit(1))
    want = (
        rows.withColumn("b", brk)
        .withColumn("r", F.sum("b").over(W))
        .groupBy("v", "r")
        .agg(F.min("f").alias("run_start"), F.max("f").alias("run_end"), F.count("*").alias("n_rows"))
        .drop("r")
    )
    same(B.runs(rows, ["v"], "f", max_step=2, block=block), want)
    same(
        B.row_index(rows, ["v"], "f", block=block),
        rows.withColumn("row_idx", (F.row_number().over(W) - 1).cast("long")),
    )
    mark = F.when(F.col("g"), F.col("f"))
    back, ahead = W.rowsBetween(Window.unboundedPreceding, 0), W.rowsBetween(0, Window.unboundedFollowing)
    same(B.carry_forward(rows, ["v"], "f", mark, "c", block=block), rows.withColumn("c", F.max(mark).over(back)))
    same(B.carry_backward(rows, ["v"], "f", mark, "c", block=block), rows.withColumn("c", F.min(mark).over(ahead)))


@pytest.mark.parametrize("block", [2, 1000])
def test_ties(spark, block):
    """Rows at one position stand in the order of the tie column."""
    df = spark.createDataFrame([("v", 1, 5), ("v", 1, 3), ("v", 2, 9), ("v", 2, 1), ("v", 4, 0)], "v string, f int, t int")
    nb = B.Neighbours(df, ["v"], "f", tie=["t"], back=1, ahead=2, block=block)
    got = {(r["f"], r["t"]): (r["p"], r["n"]) for r in nb.with_columns({"p": nb.lag("t"), "n": nb.lead("t", 2)}).collect()}
    assert got == {(1, 3): (None, 1), (1, 5): (3, 9), (2, 1): (5, 0), (2, 9): (1, None), (4, 0): (9, None)}


@pytest.mark.parametrize("block", [2, 1000])
def test_rows_without_key_or_order_stay(spark, block):
    data = [("v", 1), ("v", 2), ("v", None), (None, 1), (None, None), ("w", -3), ("w", None)]
    df = spark.createDataFrame(data, "v string, f int")
    nb = B.Neighbours(df, ["v"], "f", back=1, block=block)
    for out, name, want in (
        (nb.with_columns({"p": nb.lag("f")}), "p", {("v", 2): 1}),
        (B.row_index(df, ["v"], "f", block=block), "row_idx", {("v", 1): 0, ("v", 2): 1, ("w", -3): 0}),
        (B.with_runs(df, ["v"], "f", block=block), "run_start", {("v", 1): 1, ("v", 2): 1, ("w", -3): -3}),
        (B.carry_forward(df, ["v"], "f", F.col("f"), "c", block=block), "c", {("v", 1): 1, ("v", 2): 2, ("w", -3): -3}),
        (B.carry_backward(df, ["v"], "f", F.col("f"), "c", block=block), "c", {("v", 1): 1, ("v", 2): 2, ("w", -3): -3}),
    ):
        rows = out.collect()
        assert len(rows) == len(data) and {(r["v"], r["f"]): r[name] for r in rows if r[name] is not None} == want
    assert B.runs(df, ["v"], "f", block=block).count() == 2


@pytest.mark.parametrize("name", ["neighbours", "ahead", "runs", "total", "forward", "backward"])
def test_rows_are_computed_once(spark, name):
    """What crosses the block borders comes from the exchange of the rows, not from a second computation."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    raw = spark.createDataFrame([("v", k, k % 3, "x") for k in range(50)] + [(None, 1, 1, "y")], "v string, f int, n int, note string")
    df = raw.mapInArrow(count, raw.schema)
    if name in ("neighbours", "ahead"):
        nb = B.Neighbours(df, ["v"], "f", block=8, **({"back": 1} if name == "neighbours" else {"back": 2, "ahead": 2}))
        out = nb.with_columns({"p": nb.lag("n")})
    elif name == "runs":
        out = B.with_runs(df, ["v"], "f", block=8)
    elif name == "total":
        out = B.running_total(df, ["v"], "f", F.col("n"), "s", block=8)
    else:
        carry = B.carry_forward if name == "forward" else B.carry_backward
        out = carry(df, ["v"], "f", F.col("n"), "s", block=8)
    assert len(out.collect()) == 51
    assert seen.value == 51

"""Analysis reports: difficulty manifest, distributions, correlations, nearest neighbours, CKA."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions import boxes as bx
from trackspark.operators.distributions import quantile_row, rank_correlation
from trackspark.session import cut_lineage

# Difficulty proxies, True where more is harder.
PROXIES: dict[str, bool] = {
    "frac_high_occlusion": True,
    "mean_overlapping_pairs": True,
    "mean_pairwise_bbox_iou": True,
    "frac_object_count_change": True,
    "num_occlusion_periods_per_min": True,
    "mean_centroid_distance": False,
    "mean_separation_score": False,
}


def difficulty_proxies(frames: DataFrame, periods: DataFrame, fps: DataFrame) -> DataFrame:
    """Per video: crowding shares and means over its frames. Duration is the last frame / fps."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    per = frames.groupBy("video_id").agg(
        share("is_high_occlusion").alias("frac_high_occlusion"),
        F.avg("num_overlapping_pairs").alias("mean_overlapping_pairs"),
        F.avg("mean_pairwise_bbox_iou").alias("mean_pairwise_bbox_iou"),
        share("is_object_count_change").alias("frac_object_count_change"),
        bx.finite_mean("mean_centroid_distance").alias("mean_centroid_distance"),
        F.avg("separation_score").alias("mean_separation_score"),
        F.max("frame_idx").alias("_last"),
    )
    n = periods.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    out = per.join(n, "video_id", "left").join(fps.select("video_id", "fps"), "video_id", "left")
    minutes = F.col("_last") / F.coalesce(F.col("fps").cast("double"), F.lit(25.0)) / 60.0
    rate = F.when(minutes > 0, F.coalesce("_n", F.lit(0)) / minutes).otherwise(F.lit(0.0))
    return out.withColumn("num_occlusion_periods_per_min", rate).drop("_last", "_n", "fps")


def difficulty_manifest(proxies: DataFrame, registry: dict[str, bool] | None = None) -> DataFrame:
    """Rank every proxy over the videos, add the ranks up, rank within the cage (1 = hardest).

    Input and windows are one row per video.
    """
    registry = PROXIES if registry is None else registry
    out = proxies
    for name, harder in registry.items():
        order = F.col(name).asc() if harder else F.col(name).desc()
        out = out.withColumn(f"rank_{name}", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(order)))
    total = sum((F.col(f"rank_{c}") for c in registry), F.lit(0))
    out = out.withColumn("difficulty", total.cast("int")).withColumn("cage", F.substring("video_id", 1, 2))
    in_cage = F.rank().over(Window.partitionBy("cage").orderBy(F.col("difficulty").desc()))
    out = out.withColumn("rank_in_cage", in_cage)
    return out.withColumn("selected", F.col("rank_in_cage") == 1).drop(*[f"rank_{c}" for c in registry])


def require_selected(manifest: DataFrame, day: str, at_least: int) -> DataFrame:
    """Fail unless enough selected videos are from ``day``."""
    n = manifest.filter(F.col("selected") & F.col("video_id").endswith(f"D{day}")).count()
    if n < at_least:
        raise ValueError(f"only {n} selected videos are from day {day}, expected {at_least}")
    return manifest


def group_shares(df: DataFrame, group: str, value: str) -> DataFrame:
    """Counts per (group, value) and their percentage of the group."""
    n = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(group)))


def pivot_shares(df: DataFrame, group: str, value: str, values: Sequence[str]) -> DataFrame:
    """One row per group, the share of each value as a column."""
    p = df.groupBy(group).pivot(value, list(values)).count().fillna(0)
    total = sum((F.col(v) for v in values), F.lit(0))
    return p.withColumns({v: F.col(v) / total for v in values})


def window_score_stats(tracks: DataFrame, keys: Sequence[str], score: str = "tracker_score") -> DataFrame:
    return tracks.groupBy(*keys).agg(
        F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.count(F.lit(1)).alias("n_frames")
    )


def quantile_bins(df: DataFrame, column: str, q: int = 4, name: str = "bin") -> DataFrame:
    """1-based quantile bins, right-closed, exact edges over the whole table."""
    edges = quantile_row(df, [column], [i / q for i in range(1, q)], "_e_")
    rank = F.size(F.filter(f"_e_{column}", lambda e: F.col(column) > e)) + 1
    # One row of q - 1 numbers.
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(column).isNotNull(), rank)).drop(f"_e_{column}")


def width_bins(df: DataFrame, column: str, n: int = 10, name: str = "bin") -> DataFrame:
    """1-based equal-width bins between the extremes, right-closed; the minimum is in bin 1."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    x = F.col(column)
    step = (F.col("_hi") - F.col("_lo")) / n
    raw = F.ceil((x - F.col("_lo")) / step)
    bin_ = F.when(step == 0, F.lit(1)).otherwise(F.least(F.greatest(raw, F.lit(1)), F.lit(n)))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.when(x.isNotNull(), bin_).cast("int")).drop("_lo", "_hi")


def correlations(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Per group: rows, Spearman rank correlation and point-biserial (Pearson) correlation.

    Ranks are those of the distinct pairs with their counts; they are never joined back to rows. Null for
    a constant column.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, x, F.col(y).cast("double").alias(y))
    # Not corr: a constant column makes it fail.
    dx, dy = F.stddev_pop(x), F.stddev_pop(y)
    pearson = F.when((dx > 0) & (dy > 0), F.covar_pop(x, y) / dx / dy)
    plain = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), pearson.alias("point_biserial"))
    pairs = rows.groupBy(by, x, y).agg(F.count(F.lit(1)).alias("_w"))
    return plain.join(rank_correlation(pairs, [by], x, y, "_w"), by).select(by, "n", "spearman", "point_biserial")


def importance(attributions: DataFrame, *, suffixes: Sequence[str], families: dict[str, str]) -> DataFrame:
    """Mean absolute attribution per (feature family, class, statistic column).

    ``attributions``: class, column, value. The statistic suffix is stripped, then related
    features are merged by name.
    """
    pattern = "_(" + "|".join(suffixes) + ")$"
    base = F.regexp_replace("column", pattern, "")
    names = F.create_map(*[F.lit(x) for kv in families.items() for x in kv]) if families else None
    family = F.coalesce(names[base], base) if names is not None else base
    per = attributions.withColumn("feature", family).groupBy("feature", "class", "column").agg(
        F.avg(F.abs("value")).alias("importance")
    )
    mean = per.groupBy("feature").agg(F.avg("importance").alias("feature_mean"))
    return per.join(mean, "feature")


# --- vectors ----------------------------------------------------------------------------


def unit(v: str | Column) -> Column:
    """Vector scaled to length 1 (double)."""
    a = F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(a, lambda x: x / norm)


#: Pivots on the driver, members of a part that are compared at once, queries to them in one task.
PIVOTS, SLICE_ROWS, QUERY_ROWS = 64, 2048, 16_384
#: Members, of whole slices, that meet others in one matrix product.
BUNDLE_ROWS = 4096
#: Rounding of distances and similarities never hides a partner that is within this of the best.
SLACK = 1e-6


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def _placed(centres: np.ndarray):
    """For ``mapInArrow`` on ``k, v``: adds the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_vectors(b.column(1)), centres)
                p = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], names=["k", "v", "p", "r"])

    return run


def _open(v: np.ndarray, near: np.ndarray, centres: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows by parts: whether the part may hold a vector nearer than ``near``.

    A vector at distance d from a pivot is at least d - high and low - d from all members of its part,
    whose own distances lie between low and high.
    """
    d = _distances(v, centres)
    return np.maximum(d - high, low - d) <= near[:, None] + SLACK


def _first_best(s: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of the best similarity along an axis; those equal in 12 digits go to the first.

    Only what is next to the best is rounded.
    """
    top = np.round(s.max(axis), 12)
    r, c = np.nonzero(s >= np.expand_dims(top - 1e-12, axis))
    at, other = (r, c) if axis == 1 else (c, r)
    hit = np.round(s[r, c], 12) == top[at]
    place = np.zeros(len(top), np.int64)
    place[at[hit][::-1]] = other[hit][::-1]  # the first one is written last
    return place, top


def _best(x: np.ndarray, keys: np.ndarray, y: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``y`` for each of ``x`` and its similarity; ``own``: the same rows, none with itself."""
    n, sim = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ y.T
        if own:
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        j, sim[a : a + 512] = _first_best(s, 1)
        n[a : a + 512] = keys[j]
    return n, sim


def _best_both(x: np.ndarray, x_keys: np.ndarray, y: np.ndarray, y_keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nearest of the other side for each of ``x`` and each of ``y``, from one product; keys ascend."""
    n, sim = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)
    m, back = np.zeros(len(y), np.int64), np.full(len(y), -np.inf)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ y.T
        j, sim[a : a + 512] = _first_best(s, 1)
        n[a : a + 512] = y_keys[j]
        i, top = _first_best(s, 0)
        more = top > back
        m[more], back[more] = x_keys[a + i[more]], top[more]
    return n, sim, m, back


SLICES = "p int, s int, k array<bigint>, v binary, near array<double>, n array<bigint>, sim array<double>, asks array<int>"


def _slice(centres: np.ndarray, low: np.ndarray, high: np.ndarray):
    """For ``applyInPandas``: a slice as one row, with each member's best inside and the parts any of them asks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        k, v = pdf["k"].to_numpy(), np.stack(pdf["v"].to_numpy())
        n, sim = _best(v, k, v, own=True)
        near = np.sqrt(np.maximum(2 - 2 * np.maximum(sim, -1), 0))
        asks = np.flatnonzero(_open(v, near, centres, low, high).any(0))
        row = [pdf["p"].iloc[0], pdf["s"].iloc[0], k, v.astype(np.float64).tobytes(), near, n, sim, asks]
        return pd.DataFrame({name.split()[0]: [value] for name, value in zip(SLICES.split(", "), row)})

    return run


BUNDLES = "b int, k array<bigint>, v binary, p array<int>, near array<double>, n array<bigint>, sim array<double>, asks array<int>, parts array<int>"


def _bundle(centres: np.ndarray, low: np.ndarray, high: np.ndarray):
    """For ``applyInPandas``: some slices as one row, with each member's best inside and the parts any of them asks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        k, v, p = pdf["k"].to_numpy(), np.stack(pdf["v"].to_numpy()), pdf["p"].to_numpy()
        n, sim = _best(v, k, v, own=True)
        near = np.sqrt(np.maximum(2 - 2 * np.maximum(sim, -1), 0))
        asks = np.flatnonzero(_open(v, near, centres, low, high).any(0))
        row = [pdf["b"].iloc[0], k, v.astype(np.float64).tobytes(), p, near, n, sim, asks, np.unique(p)]
        return pd.DataFrame({name.split()[0]: [value] for name, value in zip(BUNDLES.split(", "), row)})

    return run


def _across(centres: np.ndarray, low: np.ndarray, high: np.ndarray):
    """For ``mapInArrow`` on pairs of bundles: the best of the other for the members of either that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k, near, p, keys, far, q = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("k", "near", "p", "keys", "far", "q"))
                x = np.frombuffer(b.column("v")[i].as_buffer(), np.float64).reshape(len(k), -1)
                y = np.frombuffer(b.column("w")[i].as_buffer(), np.float64).reshape(len(keys), -1)

                def asked(v: np.ndarray, dist: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    """Members that ask the other bundle, and the members of it that they ask for."""
                    there, of = np.unique(parts, return_inverse=True)
                    open_ = _open(v, dist, centres[there], low[there], high[there])
                    return open_.any(1), open_.any(0)[of]

                (x_asks, y_met), (y_asks, x_met) = asked(x, near, q), asked(y, far, p)
                rows, others = np.flatnonzero(x_asks | x_met), np.flatnonzero(y_asks | y_met)
                if not len(rows) or not len(others):
                    continue
                n, sim, m, back = _best_both(x[rows], k[rows], y[others], keys[others])
                mine, yours = x_asks[rows], y_asks[others]
                out = [(k[rows][mine], keys[others][yours]), (n[mine], m[yours]), (sim[mine], back[yours])]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["k", "n", "sim"])

    return run


def _dealt(df: DataFrame, key: str, vec: str, pivots: int, slice_rows: int) -> tuple[DataFrame, tuple[np.ndarray, ...], np.ndarray]:
    """Vectors with part ``p``, slice ``s`` and bundle ``b``, the pivots with the extremes of their parts, and the slices of each part."""
    rows = cut_lineage(df.select(F.col(key).cast("long").alias("k"), unit(vec).alias("v")).filter("v is not null"), "units")
    spark = df.sparkSession
    centres = np.array([r["v"] for r in rows.orderBy(F.xxhash64("k"), "k").limit(pivots).collect()])
    placed = cut_lineage(rows.mapInArrow(_placed(centres), "k long, v array<double>, p int, r double"), "placed")
    # One row for each pivot.
    found = {r["p"]: r for r in placed.groupBy("p").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).collect()}
    low, high = (np.array([found[p][c] if p in found else np.inf * sign for p in range(len(centres))]) for c, sign in (("low", 1), ("high", -1)))
    numbers = np.array([-(-found[p]["n"] // slice_rows) if p in found else 0 for p in range(len(centres))], np.int64)
    before = np.cumsum(numbers) - numbers
    sizes = spark.createDataFrame([(p, int(n), int(o)) for p, (n, o) in enumerate(zip(numbers, before))], "p int, n int, o int")
    members = placed.join(F.broadcast(sizes), "p").withColumn("s", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    # Slices of one part, then of the next.
    bundle = F.floor((F.col("o") + F.col("s")) / max(1, BUNDLE_ROWS // slice_rows)).cast("int")
    return members.select("k", "v", "p", "s", bundle.alias("b")), (centres, low, high), numbers


def _inside(slices: DataFrame) -> DataFrame:
    best = slices.select(F.inline(F.arrays_zip("k", "n", "sim")))
    return best.filter(F.col("sim") > F.lit(-np.inf))  # a slice of one member has none


def neighbour_asks(df: DataFrame, *, key: str, vec: str, pivots: int = PIVOTS, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Slices, each member's best inside its slice, the asks of members to other slices, and the slice count."""
    members, bounds, numbers = _dealt(df, key, vec, pivots, slice_rows)
    slices = cut_lineage(members.select("k", "v", "p", "s").groupBy("p", "s").applyInPandas(_slice(*bounds), SLICES), "slices")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                v = np.frombuffer(r["v"], np.float64).reshape(len(r["k"]), -1)
                row, p = np.nonzero(_open(v, np.array(r["near"]), *bounds))
                n = numbers[p] - (p == r["p"])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(r["k"])[row]), pa.array(p.astype(np.int32)), pa.array(n)], names=["k", "p", "n"])

    asks = slices.mapInArrow(asked, "k long, p int, n long").withColumn("s", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).drop("n", "s")
    return slices, _inside(slices), asks, int(numbers.sum())


def nearest_neighbour(df: DataFrame, *, key: str, vec: str, pivots: int = PIVOTS, slice_rows: int = SLICE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Exact cosine nearest neighbour of every vector: (key, neighbour, similarity).

    Vectors belong to the nearest of a few pivots, a part's members to slices of bounded size, and slices to bundles,
    one row each. The best partner inside the own bundle bounds how far a nearer one can be; by the triangle
    inequality only bundles that hold a part with one are asked, by one matrix product for each two
    bundles, which serves both. Pairs are formed by reading the stage table of bundles again, so that no vector is
    shuffled for its pairs: disk grows with the vectors, not with their pairs. ``query_rows`` no longer bounds anything.
    Ties go to the lowest key.
    """
    if df.isEmpty():
        return df.select(F.col(key).cast("long").alias(key), F.lit(0).cast("long").alias("neighbour"), F.lit(0.0).alias("similarity")).limit(0)
    members, bounds, _ = _dealt(df, key, vec, pivots, slice_rows)
    bundles = cut_lineage(members.drop("s").groupBy("b").applyInPandas(_bundle(*bounds), BUNDLES), "bundles")
    left = bundles.select("b", "k", "v", "p", "near", "asks", "parts")
    right = bundles.select(
        F.col("b").alias("c"), F.col("k").alias("keys"), F.col("v").alias("w"), F.col("p").alias("q"), F.col("near").alias("far"),
        F.col("asks").alias("their_asks"), F.col("parts").alias("their_parts"),
    )
    # The product of partitions, never a broadcast.
    meet = F.arrays_overlap("asks", "their_parts") | F.arrays_overlap("their_asks", "parts")
    pairs = left.join(right.hint("shuffle_replicate_nl"), (F.col("b") < F.col("c")) & meet)
    across = pairs.select("k", "near", "v", "p", "keys", "far", "w", "q").mapInArrow(_across(*bounds), "k long, n long, sim double")
    top = _inside(bundles).unionByName(across).groupBy("k").agg(F.min(F.struct((-F.col("sim")).alias("d"), "n")).alias("t"))
    return top.select(F.col("k").alias(key), F.col("t.n").alias("neighbour"), (-F.col("t.d")).alias("similarity"))


def purity(df: DataFrame, neighbours: DataFrame, *, key: str, label: str) -> DataFrame:
    """Per class: rows, share whose nearest neighbour agrees, chance level and lift."""
    lab = df.select(F.col(key), F.col(label).alias("class"))
    other = lab.select(F.col(key).alias("neighbour"), F.col("class").alias("_other"))
    j = neighbours.join(lab, key).join(other, "neighbour")
    per = j.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("class") == F.col("_other")).cast("double")).alias("purity")
    )
    chance = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per class
    return per.withColumn("chance", chance).withColumn("lift", F.col("purity") / F.col("chance"))


def linear_cka(df: DataFrame, x: str, y: str) -> DataFrame:
    """Linear CKA of two representations with the self-pairs left out, as one row.

    Sums over pairs reduce to d x d products, so rows meet only as partial matrices: every
    partition folds its rows into three small matrices and these are added up.
    """

    def mean_vector(c: str) -> DataFrame:
        def sums(batches):
            total, n = 0.0, 0
            for pdf in batches:
                if len(pdf):
                    total, n = total + np.stack(pdf[c].to_numpy()).astype(float).sum(0), n + len(pdf)
            if n:
                yield pd.DataFrame({"i": np.arange(len(total)), "s": total, "n": n})

        cells = df.select(c).mapInPandas(sums, "i int, s double, n long").groupBy("i")
        items = cells.agg((F.sum("s") / F.sum("n")).alias("m"))
        return items.agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("o")).select(
            F.transform("o", lambda e: e["m"]).alias(f"_m_{c}")
        )

    centred = df.select(x, y).crossJoin(F.broadcast(mean_vector(x))).crossJoin(F.broadcast(mean_vector(y)))
    sub = lambda c: F.zip_with(F.col(c), F.col(f"_m_{c}"), lambda v, m: v.cast("double") - m)
    rows = centred.select(sub(x).alias("x"), sub(y).alias("y"))

    def partial(batches):
        sums = None
        for pdf in batches:
            if not len(pdf):
                continue
            a, b = np.stack(pdf["x"].to_numpy()), np.stack(pdf["y"].to_numpy())
            na, nb = (a * a).sum(1), (b * b).sum(1)
            new = {
                "xy": a.T @ b, "xx": a.T @ a, "yy": b.T @ b,
                "dxy": np.array([[(na * nb).sum()]]), "dxx": np.array([[(na * na).sum()]]), "dyy": np.array([[(nb * nb).sum()]]),
            }
            sums = new if sums is None else {k: sums[k] + new[k] for k in new}
        if sums is not None:
            for name, m in sums.items():
                i, j = np.indices(m.shape)
                yield pd.DataFrame({"m": name, "i": i.ravel(), "j": j.ravel(), "v": m.ravel()})

    cells = rows.mapInPandas(partial, "m string, i int, j int, v double").groupBy("m", "i", "j").agg(F.sum("v").alias("v"))
    norm = cells.groupBy("m").agg(F.sum(F.when(F.col("m").startswith("d"), F.col("v")).otherwise(F.col("v") ** 2)).alias("s"))
    wide = norm.groupBy().pivot("m", ["xy", "xx", "yy", "dxy", "dxx", "dyy"]).agg(F.first("s"))
    c = F.col
    return wide.select(
        ((c("xy") - c("dxy")) / F.sqrt((c("xx") - c("dxx")) * (c("yy") - c("dyy")))).alias("cka")
    )


def best_rows(df: DataFrame, metric: str, k: int = 1) -> DataFrame:
    return df.orderBy(F.col(metric).desc(), *[c for c in df.columns if c != metric]).limit(k)


# --- integrity --------------------------------------------------------------------------


def integrity(tracks: DataFrame, labels: DataFrame, *, frames_per_window: int = 125, low: int = 63, high: int = 127) -> DataFrame:
    """One row per expectation: name and number of violations."""
    win = ["video_id", "bird_id", "window"]
    sizes = tracks.groupBy(*win).agg(F.count(F.lit(1)).alias("n"))
    dup = tracks.groupBy("video_id", "bird_id", "frame_idx").agg(F.count(F.lit(1)).alias("n"))
    cages = tracks.select("bird_id", F.substring("video_id", 1, 2).alias("cage")).distinct().groupBy("bird_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    a, b = tracks.select(*win).distinct(), labels.select(*win).distinct()

    def check(name: str, df: DataFrame, n: Column) -> DataFrame:
        return df.agg(n.cast("long").alias("n_bad")).select(F.lit(name).alias("expectation"), "n_bad")

    off = F.count_if(F.col("n") != frames_per_window)
    parts = [
        check("window_not_too_long", sizes, F.count_if(F.col("n") > high)),
        check("window_not_too_short", sizes, F.count_if(F.col("n") < low)),
        check("nine_in_ten_windows_exact", sizes, F.when(off > 0.1 * F.count(F.lit(1)), off).otherwise(F.lit(0))),
        check("no_duplicate_rows", dup, F.count_if(F.col("n") > 1)),
        check("bird_in_one_cage", cages, F.count_if(F.col("n") > 1)),
        check("windows_have_labels", a.join(b, win, "left_anti"), F.count(F.lit(1))),
        check("labels_have_windows", b.join(a, win, "left_anti"), F.count(F.lit(1))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

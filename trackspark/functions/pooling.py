"""Sequence pooling expressions on arrays of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _mean(steps: Column) -> Column:
    """Mean vector of a non-empty array of vectors."""
    first = F.transform(F.get(steps, F.lit(0)), lambda x: x.cast("double"))
    total = F.aggregate(
        F.slice(steps, 2, F.size(steps)),
        first,
        lambda acc, v: _add(acc, F.transform(v, lambda x: x.cast("double"))),
    )
    return F.transform(total, lambda x: x / F.size(steps))


def mean_pool(seq: str | Column) -> Column:
    """(T, D) to (D)."""
    return _mean(_c(seq))


def segment_pool(seq: str | Column, k: int) -> Column:
    """(T, D) to (k, D): bin i averages steps floor(iT/k) to ceil((i+1)T/k); bins may overlap."""
    s = _c(seq)
    t = F.size(s)

    def one(i: Column) -> Column:
        lo = F.floor(i * t / k).cast("int")
        hi = F.ceil((i + 1) * t / k).cast("int")
        return _mean(F.slice(s, lo + 1, hi - lo))

    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), one)


def concat_features(a: str | Column, b: str | Column) -> Column:
    """Join two sequences on the feature axis, step by step."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.concat(x, y))


def standardise(seq: str | Column, mean: Column, std: Column) -> Column:
    """Z-score every step with vectors of means and standard deviations."""
    return F.transform(
        _c(seq),
        lambda v: F.zip_with(
            F.zip_with(v, mean, lambda x, m: x.cast("double") - m), std, lambda x, s: x / s
        ),
    )


def chunk_array(values: str | Column, width: int) -> Column:
    """A flat vector as steps of ``width`` values."""
    v = _c(values)
    n = F.floor(F.size(v) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(v, i * width + 1, width))


def even_positions(n: int, count: Column) -> Column:
    """0-based positions of ``n`` evenly spaced rows out of ``count``."""
    if n == 1:
        return F.array(F.lit(0).cast("long"))
    picked = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (count - 1) / (n - 1)).cast("long")
    )
    every = F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)
    return F.when(count <= n, every).otherwise(picked)

"""Aggregate expressions with sample (bias-corrected) semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: str | Column) -> Column:
    """NaN counts as missing."""
    col = F.col(c) if isinstance(c, str) else c
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def sample_skewness(c: Column) -> Column:
    """NULL below 3 values; 0 for a constant group."""
    n = F.count(c).cast("double")
    value = F.coalesce(F.skewness(c), F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(value))


def sample_kurtosis(c: Column) -> Column:
    """Excess kurtosis; NULL below 4 values; 0 for a constant group."""
    n = F.count(c).cast("double")
    g2 = F.coalesce(F.kurtosis(c), F.lit(0.0))
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(value))


def variation(c: Column) -> Column:
    """Sample standard deviation over mean; NULL for a zero mean."""
    return F.when(F.avg(c) != 0, F.stddev_samp(c) / F.avg(c))


def quantile(q: float) -> Callable[[Column], Column]:
    """Exact quantile with linear interpolation."""
    return lambda c: F.percentile(c, F.lit(q))


#: Summary statistics by name. ``mad`` needs the group median and is added by the operator.
SUMMARY: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "median": quantile(0.5),
    "skew": sample_skewness,
    "kurt": sample_kurtosis,
    "cv": variation,
    "q10": quantile(0.1),
    "q90": quantile(0.9),
}


def logistic(c: str | Column) -> Column:
    """Raw score logits to probabilities."""
    col = F.col(c) if isinstance(c, str) else c
    return 1 / (1 + F.exp(-col))

"""Null-safe arithmetic and statistics over arrays of pixels, as Column expressions.

A frame is one row and its pixels are arrays, so a masked summary is a
projection: it is computed where the frame is read, without exploding pixels
and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

EPS = 1e-6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def fin(c: Column) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def safe_div(num, den, eps: float = EPS):
    """num / den where both are finite and the denominator exceeds eps in size; the sign is kept.

    Columns give null elsewhere, numpy arrays NaN.
    """
    if isinstance(den, np.ndarray):
        size = np.abs(den)
        ratio = np.where((size > eps) & (size < np.inf), num, np.nan) / den
        return np.where(np.isfinite(ratio), ratio, np.nan)
    size = F.abs(den)  # not a number is larger than any, so both limits exclude it
    ratio = F.when((size > eps) & (size < float("inf")), num / den)
    return F.when(F.abs(ratio) < float("inf"), ratio)


def finite(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def quantile_of_sorted(ordered: Column, q: float) -> Column:
    """Linear interpolation between order statistics; null for no values."""
    at = (F.size(ordered) - 1) * F.lit(q)
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    low, high = F.get(ordered, lo), F.get(ordered, hi)
    return F.when(F.size(ordered) > 0, low + (high - low) * (at - F.floor(at)))


STATS = ("median", "mean", "p10", "p90", "std", "n")


def summary(values: Column) -> Column:
    """struct(median, mean, p10, p90, std, n) of the finite values; population std; null statistics for none."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        some = n > 0
        mean = F.when(some, total(s) / n)
        return let(mean, lambda m: F.struct(
            quantile_of_sorted(s, 0.5).alias("median"),
            m.alias("mean"),
            quantile_of_sorted(s, 0.1).alias("p10"),
            quantile_of_sorted(s, 0.9).alias("p90"),
            F.when(some, F.sqrt(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / n)).alias("std"),
            n.cast("long").alias("n"),
        ))

    return let(F.sort_array(finite(values)), of_sorted)


def with_summaries(df: DataFrame, arrays: dict[str, Column]) -> DataFrame:
    """``df`` with the statistics of each named array as one more struct column."""
    found = "_summaries"
    while found in df.columns:
        found = f"_{found}"
    # one function over an array of arrays is planned once, not once per array
    every = df.withColumn(found, F.transform(F.array(*arrays.values()), summary))
    return every.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(found)[i].alias(k) for i, k in enumerate(arrays)))


def where_mask(values: Column, mask: Column) -> Column:
    """The values at the true places of a mask of the same length."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda p: F.coalesce(p["m"], F.lit(False))), lambda p: p["v"])


def count_true(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: F.coalesce(m, F.lit(False)))).cast("long")


def indices(mask: Column) -> Column:
    """0-based places of the true values."""
    flagged = F.transform(mask, lambda m, i: F.when(m, i))
    return F.filter(flagged, lambda i: i.isNotNull())

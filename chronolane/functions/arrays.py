"""Exact order statistics of array columns, for groups small enough to be one value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_median(a: Column) -> Column:
    """Median of an ascending array: the mean of the middle two."""
    n = F.size(a)
    low, high = F.get(a, F.floor((n - 1) / 2).cast("int")), F.get(a, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def tukey_iqr(a: Column) -> Column:
    """Upper minus lower hinge of an ascending array, the median left out of both halves; 0 below two values."""
    n = F.size(a)
    half = F.floor(n / 2).cast("int")
    lower, upper = F.slice(a, F.lit(1), half), F.slice(a, n - half + 1, half)
    return F.when(n < 2, F.lit(0.0)).otherwise(sorted_median(upper) - sorted_median(lower))


def mad(a: Column, center: Column) -> Column:
    """Median absolute deviation from center."""
    return sorted_median(F.array_sort(F.transform(a, lambda x: F.abs(x - center))))

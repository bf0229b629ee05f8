"""Exact ranks and order statistics of groups of any size: no group is one task, one sort or one array."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def joined_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, where the keys are equal; nulls are equal too."""
    named = right.select(*(F.col(k).alias(f"_right_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys), F.lit(True))
    return left.join(named, same, how).drop(*(f"_right_{k}" for k in keys))


def ranked(rows: DataFrame, by: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """rows with `before`, the rows (or the weight) of their group that come before, and `total` of the group. Written.

    Rows are dealt by ranges of group and order, so a large group is spread over many pieces; pieces
    are summed and cumulated (a row for each group and piece), and only within a piece are rows sorted.
    order ascends, nulls first, and is to end in something unique: rows that are equal in it share a piece.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    pieces = written(rows.withColumn("_w", w).repartitionByRange(*by, *order).withColumn("_piece", F.spark_partition_id()), "pieces")
    sums = pieces.groupBy(*by, "_piece").agg(F.sum("_w").alias("_sum"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    up = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_start": F.coalesce(F.sum("_sum").over(up), F.lit(0)), "total": F.sum("_sum").over(group)}).drop("_sum")
    inside = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return joined_on(placed, sums, [*by, "_piece"]).withColumn("before", F.col("_start") + F.col("_in")).drop("_start", "_in", "_piece", "_w")


def previous(rows: DataFrame, by: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """rows with, for each new name, the value that an old column has in the row before in its group; null in the first. Written.

    As in `ranked`, rows are dealt by ranges; the first row of a piece takes what the last row of the pieces before it holds.
    """
    pieces = written(rows.repartitionByRange(*by, *order).withColumn("_piece", F.spark_partition_id()), "pieces")
    took = F.struct(*(F.col(c).alias(n) for n, c in columns.items()))
    lasts = pieces.groupBy(*by, "_piece").agg(F.max_by(took, F.struct(*order)).alias("_last"))
    lasts = lasts.withColumn("_last", F.lag("_last").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_piece")))
    inside = Window.partitionBy(*by, "_piece").orderBy(*order)
    placed = pieces.withColumns({"_before": F.lag(took).over(inside), "_i": F.row_number().over(inside)})
    both = joined_on(placed, lasts, [*by, "_piece"]).withColumn("_before", F.when(F.col("_i") == 1, F.col("_last")).otherwise(F.col("_before")))
    return both.select(*rows.columns, *(F.col(f"_before.{n}").alias(n) for n in columns))


def order_statistics(counts: DataFrame, by: list[str], value: str, wanted: dict[str, Callable[[Column], Column]], n: str = "n") -> DataFrame:
    """by, `total` and the value at each wanted rank (from 0, as a function of the total) of counts(by.., value, n) of distinct values.

    A rank that no value has gives null.
    """
    at = ranked(counts, by, [value], n)
    found = [F.max(F.when((F.col("before") <= rank(F.col("total"))) & (rank(F.col("total")) < F.col("before") + F.col(n)), F.col(value))).alias(name) for name, rank in wanted.items()]
    return at.groupBy(*by).agg(F.max("total").alias("total"), *found)


def _middle(size: Callable[[Column], Column], start: Callable[[Column], Column]) -> tuple[Callable, Callable]:
    """The two middle ranks of a run of `size` ranks from `start`."""
    return (lambda t: F.when(size(t) > 0, start(t) + F.floor((size(t) - 1) / 2))), (lambda t: F.when(size(t) > 0, start(t) + F.floor(size(t) / 2)))


_ALL = _middle(lambda t: t, lambda t: F.lit(0))
_LOWER = _middle(lambda t: F.floor(t / 2), lambda t: F.lit(0))
_UPPER = _middle(lambda t: F.floor(t / 2), lambda t: t - F.floor(t / 2))


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, total, median, iqr (Tukey's hinges, the median left out of both halves; 0 below two values) and mad of each group; null values take no part."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    names = dict(zip(("m0", "m1", "l0", "l1", "u0", "u1"), (*_ALL, *_LOWER, *_UPPER)))
    s = written(order_statistics(counts, by, value, names), "statistics")
    mean = lambda x: (F.col(f"{x}0") + F.col(f"{x}1")) / 2
    s = s.select(*by, "total", mean("m").alias("median"), F.when(F.col("total") < 2, F.lit(0.0)).otherwise(mean("u") - mean("l")).alias("iqr"))
    away = joined_on(counts, s.select(*by, "median"), by).groupBy(*by, F.abs(F.col(value) - F.col("median")).alias("away")).agg(F.sum("n").alias("n"))
    d = order_statistics(away, by, "away", dict(zip(("m0", "m1"), _ALL)))
    return joined_on(s, d.select(*by, mean("m").alias("mad")), by)

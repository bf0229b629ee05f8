"""Intervals against intervals: which of two large tables' closed intervals meet, by an equi-join on bins, and totals over what meets without the pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros
from ..storage import written

#: Highest level of bins: 2 to this power of microseconds are over 140,000 years.
TOP = 62


def _level(low: Column, high: Column) -> Column:
    """The least level whose bins, 2^level wide, an interval meets at most two of."""
    return F.ceil(F.log2(F.greatest(high - low, F.lit(1)).cast("double")) + 1e-9).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level)


def _own(rows: DataFrame, side: str) -> DataFrame:
    """rows at the level of their length, one for each bin they meet there."""
    bins = F.sequence(_bin(F.col(f"{side}_low"), F.col(f"{side}_level")), _bin(F.col(f"{side}_high"), F.col(f"{side}_level")))
    return rows.withColumns({"_level": F.col(f"{side}_level"), "_bin": F.explode(bins)})


def _above(rows: DataFrame, side: str, levels: list[int], strictly: bool) -> DataFrame:
    """rows at each of levels that is not below (strictly: above) their own, one for each bin they meet there: two at most."""
    least = F.col(f"{side}_level") + int(strictly)
    at = rows.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= least)))
    return at.withColumn("_bin", F.explode(F.sequence(_bin(F.col(f"{side}_low"), F.col("_level")), _bin(F.col(f"{side}_high"), F.col("_level")))))


def meeting(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], on: list[str] | None = None) -> DataFrame:
    """All pairs of rows whose closed intervals share a moment and that agree in the `on` columns (once, from the left); other columns must differ in name.

    Each interval has a level, the power of two of its length, where it meets at most two bins. Two intervals meet in a
    bin of the higher of their levels, so one side stays at its own level and the other is laid out over the levels above
    (at most two bins for each level that occurs): an equi-join, whatever the lengths. A pair that shares two bins is kept
    in the first. An interval whose ends are null or reversed meets nothing; nor do nulls in `on`. A moment is an interval of length 0.
    """
    on = on or []

    def side(rows: DataFrame, name: str, ends: tuple[str, str]) -> DataFrame:
        low, high = micros(ends[0]), micros(ends[1])
        rows = rows.withColumns({f"{name}_low": low, f"{name}_high": high}).where(F.col(f"{name}_low") <= F.col(f"{name}_high"))
        return rows.withColumn(f"{name}_level", _level(F.col(f"{name}_low"), F.col(f"{name}_high")))

    a, b = side(left, "_l", left_ends), side(right, "_r", right_ends)
    occurring = lambda rows, name: sorted(r[0] for r in rows.select(f"{name}_level").distinct().collect())  # noqa: E731  TOP at most
    parts = []
    for x, y in ((_above(a, "_l", occurring(b, "_r"), False), _own(b, "_r")), (_own(a, "_l"), _above(b, "_r", occurring(a, "_l"), True))):
        both = x.join(y, ["_level", "_bin", *on])
        both = both.where((F.col("_l_low") <= F.col("_r_high")) & (F.col("_r_low") <= F.col("_l_high")))
        first = F.greatest(_bin(F.col("_l_low"), F.col("_level")), _bin(F.col("_r_low"), F.col("_level")))
        parts.append(both.where(F.col("_bin") == first).select(*left.columns, *(c for c in right.columns if c not in on)))
    return parts[0].unionByName(parts[1])


#: Units in which ends may all be whole, in microseconds, the longest first.
UNITS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)


def _blocks(first: Column, last: Column, top: int, kind: int) -> list[Column]:
    """The aligned blocks, 2^level wide and two at most of a level up to top, that make up first to last; null for those that do not occur."""
    out = []
    for k in range(top + 1):
        low, high = -F.shiftright(-first, k), F.shiftright(last + 1, k)
        cell = lambda at, k=k: F.struct(F.lit(kind).alias("_kind"), F.lit(k).alias("_level"), at.alias("_bin"))
        out += [F.when((low < high) & (low % 2 != 0), cell(low)), F.when((low < high) & (high % 2 != 0), cell(high - 1))]
    return out


def _points(at: Column, top: int, kind: int) -> list[Column]:
    """The block of each level up to top that a point lies in."""
    return [F.struct(F.lit(kind).alias("_kind"), F.lit(k).alias("_level"), F.shiftright(at, k).alias("_bin")) for k in range(top + 1)]


def meeting_totals(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], on: list[str], totals: dict[str, tuple[Callable, Column | str]]) -> DataFrame:
    """Rows of left that meet a row of right, as `meeting` pairs them, each with totals over all rows it meets. No pair is made.

    totals: name -> (F.sum, F.min or F.max, a column of right); any aggregate does whose parts add up by itself.
    A row meets those that begin within it and those that began before and hold its begin. Either is a range of points
    and thus two aligned blocks of a level at most: for the first, right's totals are added up by block of their begin, and the
    row asks for the blocks of its own range; for the second by blocks of their range, and the row asks for the block of its
    begin at each level. Equal intervals are one before that, so rows are made as many as different intervals, times the logarithm
    of the longest in the largest unit in which all ends are whole.
    """

    def side(rows: DataFrame, ends: tuple[str, str]) -> DataFrame:
        rows = rows.withColumns({"_low": micros(ends[0]), "_high": micros(ends[1])})
        return rows.where(F.col("_low") <= F.col("_high"))

    cell, add = ["_kind", "_level", "_bin", *on], [f(name).alias(name) for name, (f, _) in totals.items()]
    rows = side(left, left_ends)
    a = written(rows.select(*on, "_low", "_high").distinct(), "intervals")
    b = written(side(right, right_ends).groupBy(*on, "_low", "_high").agg(*(f(F.col(c) if isinstance(c, str) else c).alias(name) for name, (f, c) in totals.items())), "intervals")
    whole = [F.bool_and((F.col("_low") % u == 0) & (F.col("_high") % u == 0)) for u in UNITS]
    told = [t.agg(F.max(F.col("_high") - F.col("_low")), *whole).first() for t in (a, b)]
    unit = next(u for k, u in enumerate(UNITS) if all(t[k + 1] in (True, None) for t in told))
    top_a, top_b = ((((t[0] or 0) // unit + 1).bit_length() - 1) for t in told)
    in_units = lambda c: F.call_function("div", F.col(c), F.lit(unit))
    laid = lambda t, cells: t.withColumns({"_first": in_units("_low"), "_last": in_units("_high")}).withColumn("_cell", F.explode(F.array_compact(F.array(*cells)))).select("*", "_cell.*")
    first, last = F.col("_first"), F.col("_last")
    given = laid(b, _points(first, top_a, 0) + _blocks(first + 1, last, top_b, 1)).groupBy(*cell).agg(*add)
    asked = laid(a, _blocks(first, last, top_a, 0) + _points(first, top_b, 1)).select(*cell, "_low", "_high")
    found = asked.join(given, cell).groupBy(*on, "_low", "_high").agg(*add)
    return rows.join(found, [*on, "_low", "_high"]).select(*left.columns, *totals)

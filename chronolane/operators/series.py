"""Sequence functions over long series, cut into pieces of time so that a hot series is no single task.

Each function equals its window over the whole series, ordered by (time, tie). Windows run within a
piece; what crosses a border is carried by a table of one row for each series and piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily(time: str) -> Column:
    return F.to_date(time)


def weekly(time: str) -> Column:
    return F.to_date(F.date_trunc("week", time))


def dealt(rows: DataFrame, series: list[str], piece: Column) -> DataFrame:
    """rows with _key, the series as one value that is never null, and _piece; what follows is dealt by these two once."""
    first = F.lit("0001-01-01").cast("date")
    return rows.withColumns({"_key": F.struct(*series), "_piece": F.coalesce(piece, first)})


def befores(rows: DataFrame, time: str, tie: str, columns: list[str], back: int) -> DataFrame:
    """Dealt rows with _before: the values of `columns` in up to `back` rows before, the nearest first.

    A piece needs the last rows of the pieces before it: at most `back` of them, as each holds a row.
    """
    w = Window.partitionBy("_key", "_piece").orderBy(time, tie)
    own = rows.withColumn("_own", F.struct(*columns))
    inside = own.withColumn("_inside", F.array_compact(F.array(*(F.lag("_own", i).over(w) for i in range(1, back + 1)))))
    last = F.max_by(F.slice(F.concat(F.array("_own"), F.col("_inside")), 1, back), F.struct(time, tie))
    ends = inside.groupBy("_key", "_piece").agg(last.alias("_end"))
    up = Window.partitionBy("_key").orderBy("_piece")
    carried = F.concat(*(F.coalesce(F.lag("_end", i).over(up), F.slice("_end", 1, 0)) for i in range(1, back + 1)))
    ends = ends.select(F.col("_key").alias("_ckey"), F.col("_piece").alias("_cpiece"), carried.alias("_carry"))
    both = inside.join(ends, (F.col("_key") == F.col("_ckey")) & (F.col("_piece") == F.col("_cpiece")))
    return both.withColumn("_before", F.slice(F.concat("_inside", "_carry"), 1, back)).drop("_own", "_inside", "_carry", "_ckey", "_cpiece")


def lagged(rows: DataFrame, series: list[str], time: str, tie: str, columns: dict[str, str], piece: Column) -> DataFrame:
    """rows with each new column of `columns` holding an old one's value in the row before."""
    r = befores(dealt(rows, series, piece), time, tie, list(dict.fromkeys(columns.values())), 1)
    return r.withColumns({new: F.get("_before", F.lit(0))[old] for new, old in columns.items()}).select(*rows.columns, *columns)


def over_series(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Dealt rows with an aggregate over their whole series: by piece first, then over the pieces' few rows."""
    pieces = rows.groupBy("_key", "_piece").agg(value.alias("_part"))
    whole = pieces.select(F.col("_key").alias("_ckey"), F.col("_piece").alias("_cpiece"), F.max("_part").over(Window.partitionBy("_key")).alias(name))
    return rows.join(whole, (F.col("_key") == F.col("_ckey")) & (F.col("_piece") == F.col("_cpiece"))).drop("_ckey", "_cpiece")


def running_sum(rows: DataFrame, series: list[str], time: str, tie: str, value: str, into: str, piece: Column) -> DataFrame:
    """rows with `into`: the sum of value from the series' start up to the row."""
    keys = [*series, "_piece"]
    cut = rows.withColumn("_piece", piece)
    inside = cut.withColumn("_sum", F.sum(value).over(Window.partitionBy(*keys).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)))
    totals = cut.groupBy(*keys).agg(F.sum(value).alias("_total"))
    up = Window.partitionBy(*series).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, F.coalesce(F.sum("_total").over(up), F.lit(0)).alias("_carry"))
    both = inside.join(_told_apart(carried, keys), [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in keys], "left")
    return both.withColumn(into, F.col("_sum") + F.col("_carry")).select(*rows.columns, into)


def _told_apart(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*(F.col(k).alias(f"_c{k}") for k in keys), "_carry")

"""Quotes over time: movement, velocity, runs, dispersion, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import hours_between
from .ranks import joined_on, spread
from .series import befores, dealt, over_series, weekly

SERIES = ("market", "provider")


def movements(quotes: DataFrame, series: tuple[str, ...] = SERIES) -> DataFrame:
    """Each quote against the one before it in its series: delta, hours, velocity, and those of the pair before.

    A pair is bad if its time does not advance or a price is missing or not positive; one bad pair
    blocks the whole series. First quotes have state FIRST and no delta. Quotes are dealt once, by
    series and week; _key and _piece say how, so that what builds on the result need not deal them again.
    """
    q = befores(dealt(quotes, list(series), weekly("source_time")), "source_time", "quote_id", ["price", "source_time"], 2)
    one, two = F.get("_before", F.lit(0)), F.get("_before", F.lit(1))
    q = q.withColumns({"before": one["price"], "since": one["source_time"], "_price2": two["price"], "_since2": two["source_time"]}).drop("_before")
    q = q.withColumn("hours", hours_between("since", "source_time"))
    bad = F.col("since").isNotNull() & ~((F.col("hours") > 0) & (F.col("price") > 0) & (F.col("before") > 0))
    bad = F.coalesce(bad, F.lit(True)) | (F.col("since").isNull() & ~F.coalesce(F.col("price") > 0, F.lit(False)))
    q = over_series(q.withColumn("bad", bad), F.max("bad"), "blocked").drop("bad")
    q = q.withColumn("state", F.when(F.col("blocked"), "BLOCKED").when(F.col("since").isNull(), "FIRST").otherwise("AVAILABLE"))
    ok = F.col("state") == "AVAILABLE"
    q = q.withColumns({"delta": F.when(ok, F.col("price") - F.col("before")), "hours": F.when(ok, F.col("hours")), "delta_before": F.when(ok, F.col("before") - F.col("_price2"))})
    q = q.withColumns({"velocity": F.try_divide("delta", "hours"), "velocity_before": F.try_divide(F.col("delta_before"), hours_between("_since2", "since"))})
    return q.drop("blocked", "_price2", "_since2")


def accelerations(moved: DataFrame, series: tuple[str, ...] = SERIES) -> DataFrame:
    """Of the last three quotes of each series: (v_k - v_{k-1}) / hours between the pairs' ends. Below three, UNKNOWN."""
    m = latest(moved.select(*series, "source_time", "quote_id", "velocity", "velocity_before", "hours"), series, ("source_time", "quote_id"))
    value = F.try_divide(F.col("velocity") - F.col("velocity_before"), F.col("hours"))
    return m.select(*series, "quote_id", "velocity_before", F.col("velocity").alias("velocity_after"), value.alias("acceleration"), F.when(value.isNull(), "UNKNOWN").otherwise("AVAILABLE").alias("accel_state"))


def heat(moved: DataFrame, by: tuple[str, ...] = ("market",)) -> DataFrame:
    """Activity of a market: snapshots, changes, absolute movement, signs, providers, hours spanned."""
    up, down = F.col("delta") > 0, F.col("delta") < 0
    return moved.groupBy(*by).agg(
        F.count("*").alias("snapshots"), F.count_if(F.col("delta") != 0).alias("changes"), F.sum(F.abs("delta")).alias("abs_delta"),
        F.count_if(up).alias("ups"), F.count_if(down).alias("downs"), F.avg("velocity").alias("mean_velocity"),
        F.count_distinct("provider").alias("providers"), hours_between(F.min("source_time"), F.max("source_time")).alias("span_hours"),
    )


def pressure_runs(moved: DataFrame, series: tuple[str, ...] = SERIES) -> DataFrame:
    """Longest run of equal movement signs (no-change dropped), its direction, and whether the sign ever turned; of equal runs the first.

    Runs are counted within a week, where the movements lie. Only a week's first and last run can go on
    over its borders, so these two, and the best of the others, are all that leaves it.
    """
    w = Window.partitionBy("_key", "_piece").orderBy("source_time", "quote_id")
    s = moved.where("delta != 0").withColumn("sign", F.signum("delta").cast("int"))
    s = s.withColumn("_turn", F.coalesce(F.col("sign") != F.lag("sign").over(w), F.lit(False)).cast("int")).withColumn("run", F.sum("_turn").over(w))
    runs = s.groupBy("_key", "_piece", "run", "sign").agg(F.count("*").alias("length"))
    runs = runs.withColumn("_last", F.max("run").over(Window.partitionBy("_key", "_piece")))
    inner = (F.col("run") > 0) & (F.col("run") < F.col("_last"))
    row = F.struct("length", "sign", "run")
    weeks = runs.groupBy("_key", "_piece").agg(
        F.max_by(row, -F.col("run")).alias("first"), F.max_by(row, "run").alias("last"), F.max("_last").alias("turns"),
        F.min_by(F.when(inner, row), F.when(inner, F.struct(-F.col("length"), F.col("run")))).alias("inner"),
    )
    ends = weeks.select("_key", "_piece", "turns", F.posexplode(F.when(F.col("turns") == 0, F.array("first")).otherwise(F.array("first", "last"))).alias("pos", "x"))
    order = Window.partitionBy("_key").orderBy("_piece", "pos")
    fresh = (F.col("pos") == 1) | F.coalesce(F.col("x.sign") != F.lag("x.sign").over(order), F.lit(True))
    ends = ends.withColumn("_fresh", fresh.cast("int")).withColumn("island", F.sum("_fresh").over(order))
    long = ends.groupBy("_key", "island").agg(F.sum("x.length").alias("length"), F.max("x.sign").alias("sign"), F.min(F.struct("_piece", "x.run")).alias("begun"))
    found = long.select("_key", "length", "sign", "begun", F.col("island").alias("turns")).unionByName(weeks.where("inner is not null").select("_key", "inner.length", "inner.sign", F.struct("_piece", "inner.run").alias("begun"), F.lit(2).cast("long").alias("turns")))
    best = found.groupBy("_key").agg(F.min_by(F.struct("length", "sign"), F.struct(-F.col("length"), "begun")).alias("best"), F.max("turns").alias("turns"))
    return best.select(*(F.col(f"_key.{c}").alias(c) for c in series), F.col("best.length").alias("longest"), F.col("best.sign").alias("direction"), (F.col("turns") > 1).alias("reversed"))


def anomaly_flags(moved: DataFrame, jump: float, fast: float, least: int = 3, series: tuple[str, ...] = SERIES) -> DataFrame:
    """Flags of a series and a state by their number: few quotes win, then two flags and more, then one."""
    m = moved.withColumn("reverses", F.signum("delta") * F.signum("delta_before") < 0)
    g = m.groupBy(*series).agg(
        F.count("*").alias("snapshots"), F.coalesce(F.max(F.abs("delta") > jump), F.lit(False)).alias("jump"),
        F.coalesce(F.max(F.abs("velocity") > fast), F.lit(False)).alias("fast"), F.coalesce(F.max("reverses"), F.lit(False)).alias("reversal"),
        F.coalesce(F.max(F.col("state") == "BLOCKED"), F.lit(False)).alias("conflicted"),
    )
    flags = F.col("jump").cast("int") + F.col("fast").cast("int") + F.col("reversal").cast("int")
    state = F.when(F.col("conflicted"), "CONFLICTED").when(F.col("snapshots") < least, "INSUFFICIENT_DATA").when(flags >= 2, "ANOMALOUS").when(flags == 1, "WATCH").otherwise("NORMAL")
    return g.withColumn("flags", flags).withColumn("risk", state)


def implied_probability(quotes: DataFrame, snapshot: Column | str, price: str = "price") -> DataFrame:
    """(1/p) / sum(1/p) within a snapshot; prices that are not positive take no part."""
    w = Window.partitionBy(snapshot)
    q = quotes.where(F.col(price) > 0)
    return q.withColumn("implied", 1 / F.col(price) / F.sum(1 / F.col(price)).over(w)).withColumn("overround", F.sum(1 / F.col(price)).over(w))


def latest(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The row of each key with the greatest order columns; a grouped maximum, without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def provider_aggregate(quotes: DataFrame, by: tuple[str, ...] = ("market",)) -> DataFrame:
    """Latest quote of each provider, then median, Tukey IQR and MAD over providers; quotes without a positive price are excluded and counted.

    Order statistics come from counts of distinct prices (`ranks.spread`), so a market of any size is spread over tasks.
    """
    good = latest(quotes.where("price > 0").select(*by, "provider", "price", "source_time", "quote_id"), (*by, "provider"), ("source_time", "quote_id"))
    left_out = quotes.groupBy(*by).agg(F.count_if(~F.coalesce(F.col("price") > 0, F.lit(False))).alias("excluded"))
    both = joined_on(left_out, spread(good, list(by), "price"), list(by), "left")
    return both.select(*by, F.coalesce(F.col("total"), F.lit(0)).cast("int").alias("eligible"), "excluded", "median", "iqr", "mad")


def divergence(official: DataFrame, external: DataFrame, on: list[str]) -> DataFrame:
    """External minus official implied probability at the same key; without a partner NOT_COMPARABLE."""
    e = external.select(*on, F.col("implied").alias("external"))
    out = official.join(e, on, "left").withColumn("divergence", F.col("external") - F.col("implied"))
    return out.withColumn("state", F.when(F.col("divergence").isNull(), "NOT_COMPARABLE").otherwise("AVAILABLE"))


def market_rows(snapshots: DataFrame, keys: list[str], markets: str = "markets") -> DataFrame:
    """One row for each market and selection of a snapshot's map market -> (selection -> price)."""
    long = snapshots.select(*keys, F.explode(markets).alias("market", "prices"))
    return long.select(*keys, "market", F.explode("prices").alias("selection", "price"))


def availability(rows: DataFrame, by: str, state: str, ladder: tuple[str, ...]) -> DataFrame:
    """The gravest state of a group, where `ladder` lists states from gravest to lightest; others count as lightest."""
    rank = F.lit(0)
    for i, s in enumerate(reversed(ladder)):
        rank = F.when(F.col(state) == s, i).otherwise(rank)
    g = rows.groupBy(by).agg(F.max(rank).alias("rank"))
    return g.select(by, F.get(F.array(*map(F.lit, reversed(ladder))), F.col("rank")).alias("availability"))

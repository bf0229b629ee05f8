"""Leakage-safe splits by time, whole matches at a time, and what a split holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked


def explicit_split(rows: DataFrame, match: str, at: str, intervals: list[tuple[str, Column, Column]]) -> DataFrame:
    """A row for each match: the partition whose closed interval holds all its times; NONE or SEVERAL otherwise."""
    g = rows.groupBy(match).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    fits = F.array_compact(F.array(*(F.when((F.col("first_at") >= a) & (F.col("last_at") <= b), F.lit(n)) for n, a, b in intervals)))
    return g.withColumn("_f", fits).withColumn("partition", F.when(F.size("_f") == 1, F.col("_f")[0]).when(F.size("_f") == 0, "NONE").otherwise("SEVERAL")).drop("_f")


def folds(spark, start: str, first: str, last: str, step_days: int) -> DataFrame:
    """Fold origins from first to last: a small table, bounded by its parameters."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    o = spark.range(1).select(F.posexplode(F.sequence(at(first), at(last), F.expr(f"interval {step_days} days"))).alias("fold", "origin"))
    return o.withColumn("start", at(start))


def walk_forward(rows: DataFrame, fold_table: DataFrame, match: str, at: str, validation_days: int, holdout_days: int) -> DataFrame:
    """(fold, partition, match) for train [start, o], validation (o, o+v], holdout (o+v, o+v+h]; matches that fit none drop out.

    The folds are few: Spark broadcasts them by their size, so rows are not shuffled for the range join.
    """
    g = rows.groupBy(match).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    v = F.col("origin") + F.make_dt_interval(F.lit(validation_days))
    h = v + F.make_dt_interval(F.lit(holdout_days))
    inside = lambda low, high: (F.col("first_at") > low) & (F.col("last_at") <= high)
    part = F.when((F.col("first_at") >= F.col("start")) & (F.col("last_at") <= F.col("origin")), "train").when(inside(F.col("origin"), v), "validation").when(inside(v, h), "holdout")
    return g.join(fold_table, F.col("last_at") >= F.col("start")).withColumn("partition", part).where("partition is not null").select("fold", "partition", match)


def floor_thirds(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """rows with partition by rank within a group: below n//3 train, below 2n//3 validation, else test.

    order ascends and ends in something unique. Ranks are those of `ranked`, so a group, or with no `by` the whole table, takes many tasks.
    """
    named = rows.withColumns({f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)})
    r = ranked(named, by, [f"_o{i}" for i in range(len(order))]).drop(*(f"_o{i}" for i in range(len(order))))
    third = lambda k: F.floor(F.col("total") * k / 3)
    return r.withColumn("partition", F.when(F.col("before") < third(1), "train").when(F.col("before") < third(2), "validation").otherwise("test")).drop("before", "total")


def overlap(members: DataFrame, match: str, partition: str) -> DataFrame:
    """Matches in more than one partition."""
    return members.groupBy(match).agg(F.count_distinct(partition).alias("partitions")).where("partitions > 1")


def support(rows: DataFrame, partition: str, label: str, classes: DataFrame, least: int) -> DataFrame:
    """Support and rate of each declared class in each partition, zero included, and whether all reach `least`.

    classes(label) is a declared, small table.
    """
    counts = rows.groupBy(partition, label).agg(F.count("*").alias("support"))
    totals = rows.groupBy(partition).agg(F.count("*").alias("total"))
    every = totals.crossJoin(classes).join(counts, [partition, label], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    return every.withColumn("rate", F.col("support") / F.col("total")).withColumn("enough", F.min("support").over(Window.partitionBy(partition)) >= least)


def coverage(rows: DataFrame, features: list[str]) -> DataFrame:
    """Availability rate of each feature, and of all together (feature ALL)."""
    all_there = F.lit(True)
    for f in features:
        all_there = all_there & F.col(f).isNotNull()
    g = rows.agg(*(F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in features), F.avg(all_there.cast("double")).alias("ALL"))
    return g.unpivot([], [*features, "ALL"], "feature", "rate")


def stability(rows: DataFrame, by: list[str], state: str) -> DataFrame:
    """PASS only if all pass; UNKNOWN beats UNSTABLE."""
    s = F.col(state)
    return rows.groupBy(*by).agg(F.when(F.min(s == "PASS"), "PASS").when(F.max(s == "UNKNOWN"), "UNKNOWN").otherwise("UNSTABLE").alias("stability"))

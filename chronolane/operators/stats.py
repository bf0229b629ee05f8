"""Recency-decayed statistics of teams and leagues."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(rows: DataFrame, team: list[str], most: int = 20, event: str = "event_time", match: str = "match_id") -> DataFrame:
    """Rows of each team's most recent distinct matches, with their rank from 0; all rows of one match share it."""
    w = Window.partitionBy(*team).orderBy(F.desc(event), match)
    # the bare rank against a number lets Spark drop the rest of a hot team before the shuffle
    ranked = rows.withColumn("recency", F.dense_rank().over(w)).where(F.col("recency") <= most)
    return ranked.withColumn("recency", F.col("recency") - 1)


def weight(half_life: float, rank: str = "recency") -> Column:
    return F.exp(-math.log(2) * F.col(rank) / half_life)


def decayed_mean(value, half_life: float, where: Column | None = None) -> Column:
    """Weighted mean over ranked rows, as an aggregate; rows outside `where` or without a value take no part."""
    v = F.col(value) if isinstance(value, str) else value
    take = v.isNotNull() if where is None else v.isNotNull() & where
    w = F.when(take, weight(half_life))
    return F.try_divide(F.sum(w * v), F.sum(w))


def rating(rows: DataFrame, team: str, value: str, half_life: float = 10.0, least: int = 5, most: int = 20) -> DataFrame:
    """A team's decayed mean; below `least` rows UNKNOWN, without a value. Distinct matches are counted beside the rows."""
    g = recent(rows, [team], most).groupBy(team).agg(decayed_mean(value, half_life).alias("rating"), F.count("*").alias("rows"), F.count_distinct("match_id").alias("matches"))
    enough = F.col("rows") >= least
    return g.select(team, F.when(enough, F.col("rating")).alias("rating"), "rows", "matches", F.when(enough, "AVAILABLE").otherwise("UNKNOWN").alias("state"))


def opponent_adjusted(rows: DataFrame, ratings: DataFrame, team: str, opponent: str, value: str, half_life: float = 10.0) -> DataFrame:
    """Decayed mean of value minus the opponent's available rating; matches against unrated opponents drop out."""
    rated = ratings.where("state = 'AVAILABLE'").select(F.col(team).alias(opponent), F.col("rating").alias("opponent_rating"))
    both = recent(rows, [team]).join(rated, opponent)
    return both.groupBy(team).agg(decayed_mean(F.col(value) - F.col("opponent_rating"), half_life).alias("adjusted"), F.count("*").alias("rows"))


def paired(rows: DataFrame, match: str, kind: str, value: str, order: str, first: str, second: str) -> DataFrame:
    """first - second of each match; the last row of a kind wins, and a match without both is dropped."""
    pick = lambda k: F.max_by(F.when(F.col(kind) == k, F.col(value)), F.when(F.col(kind) == k, F.col(order)))
    g = rows.groupBy(match).agg(pick(first).alias("a"), pick(second).alias("b"))
    return g.where("a is not null and b is not null").select(match, (F.col("a") - F.col("b")).alias("difference"))


def exclusions(rows: DataFrame, reason: Column, match: str = "match_id") -> DataFrame:
    """Counts by reason: matches for WINDOW_EXCLUDED, rows for all others."""
    r = rows.withColumn("reason", reason).where("reason is not null")
    n = F.when(F.first("reason") == "WINDOW_EXCLUDED", F.count_distinct(match)).otherwise(F.count("*"))
    return r.groupBy("reason").agg(n.alias("n"))

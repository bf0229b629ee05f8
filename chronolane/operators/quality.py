"""Missingness is a state: rollups of states, blockers and conflicting claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timing import ladder

#: Severity of gate states, lightest first.
SEVERITY = ("ELIGIBLE", "PARTIALLY_ELIGIBLE", "INELIGIBLE", "BLOCKED")


def state_counts(rows: DataFrame, by: list[str], state: str) -> DataFrame:
    return rows.groupBy(*by, state).agg(F.count("*").alias("n"))


def feature_quality(rows: DataFrame, by: list[str], state: str = "state") -> DataFrame:
    """COMPLETE only if every feature is available; STALE or FUTURE_DATA hide freshness; conflicts are marked."""
    s = F.col(state)
    g = rows.groupBy(*by).agg(F.min(s == "AVAILABLE").alias("all_there"), F.max(s.isin("STALE", "FUTURE_DATA")).alias("old"), F.max(s == "CONFLICTED").alias("conflict"))
    return g.select(
        *by, F.when(F.col("all_there"), "COMPLETE").otherwise("PARTIAL").alias("completeness"), F.when(F.col("all_there"), "VERIFIED").otherwise("PARTIAL").alias("verification"),
        F.when(F.col("old"), "UNKNOWN").otherwise("FRESH").alias("freshness"), F.when(F.col("conflict"), "PRESENT").otherwise("NONE").alias("conflicts"),
    )


def dimension(blocked: Column, partial: Column) -> Column:
    """One quality dimension as an aggregate: any blocker, else any shortfall, else PASS."""
    return F.when(F.max(blocked), "BLOCKED").when(F.max(partial), "PARTIAL").otherwise("PASS")


def gate_rollup(rows: DataFrame, domain: str, feature: str, state: str) -> DataFrame:
    """The gravest state of each feature, each domain and the whole set, in one pass over grouping sets."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col(state)).cast("int")
    g = rows.withColumn("rank", rank).groupingSets([[F.col(domain), F.col(feature)], [F.col(domain)], []], F.col(domain), F.col(feature)).agg(F.max("rank").alias("rank"), F.count("*").alias("n"), F.grouping_id().alias("level"))
    scope = F.when(F.col("level") == 0, "FEATURE").when(F.col("level") == 1, "DOMAIN").otherwise("CANDIDATE_SET")
    return g.select(scope.alias("scope"), domain, feature, F.get(F.array(*map(F.lit, SEVERITY)), F.col("rank") - 1).alias("gate"), "n")


def claims(items: DataFrame, claim: str, content: str, contradicts: Column, resolutions: DataFrame) -> DataFrame:
    """CONFLICTED if a claim has two contents or a contradiction; RESOLVED once any resolution names it."""
    g = items.groupBy(claim).agg(F.count_distinct(content).alias("contents"), F.max(contradicts).alias("contradicted"))
    r = resolutions.select(claim).distinct().withColumn("_r", F.lit(True))
    conflicted = (F.col("contents") > 1) | F.col("contradicted")
    return g.join(r, claim, "left").withColumn("claim_state", ladder((conflicted & F.col("_r").isNotNull(), "RESOLVED"), (conflicted, "CONFLICTED"), otherwise="CONSISTENT")).drop("_r")


def consensus(readings: DataFrame, cell: list[str], value: str, engine: str, least: int = 2) -> DataFrame:
    """No value UNRESOLVED, two values CONFLICT, one value CONFIRMED only by `least` engines."""
    read = F.col(value).isNotNull()
    g = readings.groupBy(*cell).agg(F.count_distinct(value).alias("vals"), F.count_distinct(F.when(read, F.col(engine))).alias("engines"), F.min(value).alias("only"))
    state = ladder((F.col("vals") == 0, "UNRESOLVED"), (F.col("vals") > 1, "CONFLICT"), (F.col("engines") >= least, "CONFIRMED"), otherwise="SINGLE_ENGINE")
    return g.select(*cell, "vals", "engines", state.alias("consensus"), F.when(F.col("vals") == 1, F.col("only")).alias("value"))


def lineups(picks: DataFrame, team: str, player: str) -> DataFrame:
    """Picks and distinct players of each team, and whether each player is named once; picks are counted by player first, so a team is never one value."""
    each = picks.groupBy(team, player).agg(F.count("*").alias("_n"))
    g = each.groupBy(team).agg(F.sum("_n").alias("picked"), F.count(player).alias("players"))
    return g.withColumn("unique_players", F.col("picked") == F.col("players"))


def collection_state(state: str, items: str, refs: str) -> Column:
    """What is wrong with a typed collection: UNKNOWN has no items, NONE_CONFIRMED is empty with references, AVAILABLE is not empty, CONFLICTED has two references."""
    s, n, k = F.col(state), F.size(items), F.size(refs)
    return ladder(
        ((s == "UNKNOWN") & F.col(items).isNotNull(), "UNKNOWN_WITH_ITEMS"), ((s == "NONE_CONFIRMED") & ((n != 0) | (k < 1)), "NONE_NOT_CONFIRMED"),
        ((s == "AVAILABLE") & (n < 1), "AVAILABLE_EMPTY"), ((s == "CONFLICTED") & (k < 2), "CONFLICT_WITHOUT_TWO"), otherwise="OK",
    )

"""Joins that keep what does not match, as coded rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timing import ladder


def lookup(rows: DataFrame, known: DataFrame, key: list[str], state: str, good: str = "RESOLVED") -> DataFrame:
    """rows with reject: null if the identity is known and resolved, else why not. known has one row for each key."""
    k = known.select(*key, F.col(state).alias("_state"))
    why = ladder((F.col("_state").isNull(), "IDENTITY_MISSING"), (F.col("_state") != good, "IDENTITY_UNRESOLVED"))
    return rows.join(k, key, "left").withColumn("reject", why).drop("_state")


def compared(feed: DataFrame, other: DataFrame, key: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Outer comparison of two readings of one key: ONLY_FEED, ONLY_OTHER, AGREE or CONFLICT."""
    f, o = feed.select(*key, F.col(value).alias("_f")), other.select(*key, F.col(value).alias("_o"))
    state = ladder((F.col("_o").isNull(), "ONLY_FEED"), (F.col("_f").isNull(), "ONLY_OTHER"), (F.abs(F.col("_f") - F.col("_o")) <= tolerance, "AGREE"), otherwise="CONFLICT")
    return f.join(o, key, "full_outer").select(*key, state.alias("comparison"))


def merged(a: DataFrame, b: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Full merge: equal rows are one, different rows of one key are a FEATURE_COLLISION that keeps the first."""
    x, y = a.select(*key, F.struct(*content).alias("_a")), b.select(*key, F.struct(*content).alias("_b"))
    state = ladder((F.col("_b").isNull(), "FIRST_ONLY"), (F.col("_a").isNull(), "SECOND_ONLY"), (F.col("_a").eqNullSafe(F.col("_b")), "NOOP"), otherwise="FEATURE_COLLISION")
    j = x.join(y, key, "full_outer").withColumn("merge_state", state).withColumn("row", F.coalesce("_a", "_b"))
    return j.select(*key, "row.*", "merge_state")


def required_kinds(rows: DataFrame, key: list[str], kind: str, required: list[str]) -> DataFrame:
    """Which of the required kinds a key lacks."""
    need = F.array(*map(F.lit, required))
    return rows.groupBy(*key).agg(F.array_sort(F.array_except(need, F.collect_set(kind))).alias("lacking"))


def latest_by_kind(rows: DataFrame, key: list[str], kind: str, kinds: list[str], order: list[str], identity: str) -> DataFrame:
    """One column for each kind with the identity of its latest row, null if there is none."""
    at = lambda k: F.max_by(F.when(F.col(kind) == k, F.col(identity)), F.when(F.col(kind) == k, F.struct(*order))).alias(k)
    return rows.groupBy(*key).agg(*(at(k) for k in kinds))


def any_key(refs: DataFrame, records: DataFrame, ref: str, keys: list[str], identity: str) -> DataFrame:
    """Each reference with the record that one of several keys names; the keys are laid out so that the join is an equality."""
    long = records.select(F.col(identity).alias("record"), F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("_key"))
    return refs.join(long, F.col(ref) == F.col("_key"), "left").drop("_key")

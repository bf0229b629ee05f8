"""Samples and artifacts built from records: pivots, ordered artifacts with hashes, grids, declared sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import sha256_id
from .timing import ladder


def stable_order(samples: DataFrame, cutoff: str, match: str, sample: str) -> DataFrame:
    """samples sorted by cutoff, match and sample."""
    return samples.orderBy(cutoff, match, sample)


def source_time_order(rows: DataFrame, by: list[str], at: str, identity: str) -> DataFrame:
    """rows with place and blocked: known times first, ties by identity; one unknown time blocks its set."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(F.asc_nulls_last(at), identity))
    return rows.withColumn("place", place).withColumn("blocked", F.max(F.col(at).isNull()).over(w))


def artifact(rows: DataFrame, key: list[str], order: list[str], content: list[str]) -> DataFrame:
    """One row a key: its number of features and the hash of their contents in order. An artifact's features are few by its schema."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_text")))), lambda x: x["_text"])
    return rows.groupBy(*key).agg(F.count("*").alias("features"), sha256_id(F.array_join(parts, "\n")).alias("artifact_hash"))


def movement_pair(before: str, after: str, start: str, end: str, identity: list[str]) -> list[Column]:
    """Elapsed hours, delta and id of a pair of quotes; the id is the hash of what it pairs."""
    hours = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 3.6e9
    return [hours.alias("elapsed_hours"), (F.col(after) - F.col(before)).alias("delta"), sha256_id(F.concat_ws("|", *(F.col(c).cast("string") for c in identity))).alias("movement_id")]


def horizon(rows: DataFrame, key: str, at: str, ref: str) -> DataFrame:
    """First and last event and distinct references of each key."""
    return rows.groupBy(key).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count_distinct(ref).alias("refs"))


def pivoted(rows: DataFrame, key: str, domain: str, domains: list[str], value: str, order: list[str], sentinel: Column | None = None) -> DataFrame:
    """One row a key: each domain's latest value; null where there is none, or the sentinel. Without a sentinel `complete` says whether all are there."""
    latest = [F.max_by(F.when(F.col(domain) == d, F.col(value)), F.when(F.col(domain) == d, F.struct(*order))).alias(d) for d in domains]
    g = rows.groupBy(key).agg(*latest)
    if sentinel is not None:
        return g.select(key, *(F.coalesce(F.col(d), sentinel).alias(d) for d in domains))
    complete = F.lit(True)
    for d in domains:
        complete = complete & F.col(d).isNotNull()
    return g.withColumn("complete", complete)


def prior_sample(manifests: DataFrame, key: list[str], revision: str, sample: str) -> DataFrame:
    """The sample of each key's highest revision among earlier manifests."""
    return manifests.groupBy(*key).agg(F.max(revision).alias(revision), F.max_by(sample, F.struct(revision, sample)).alias(sample))


def partition_artifact(members: DataFrame, partition: str, match: str, ref: str) -> DataFrame:
    """Distinct matches and references of each partition and the hash of its references, which are declared and few."""
    refs = F.array_sort(F.collect_set(ref))
    return members.groupBy(partition).agg(F.count_distinct(match).alias("matches"), F.array_join(refs, ",").alias("refs"), sha256_id(F.array_join(refs, ",")).alias("refs_hash"))


def also_accepted(excluded: DataFrame, accepted: DataFrame, key: list[str]) -> DataFrame:
    """Distinct excluded entries that the accepted list holds as well; a sound manifest has none."""
    return excluded.join(accepted.select(*key), key, "left_semi").select(*key).distinct()


def grid(rows: DataFrame, plays: tuple[str, ...], number: Column) -> DataFrame:
    """Every row with every declared play and its sample number."""
    return rows.select("*", F.posexplode(F.array(*map(F.lit, plays))).alias("k", "play")).withColumn("sample", number * len(plays) + F.col("k"))


def grid_budgets(configs: DataFrame, sizes: Column, budget: str) -> DataFrame:
    """configs with grid_state, where sizes is an array of counts of values."""
    product = F.aggregate(sizes, F.lit(1).cast("long"), lambda a, x: a * x)
    return configs.withColumn("grid_state", ladder((product == F.col(budget), "OK"), otherwise="BUDGET_MISMATCH"))


def latest_is_canonical(rows: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """Whether the row inserted last also has the latest business time."""
    g = rows.groupBy(key).agg(F.max(at).alias("_top"), F.max_by(at, seq).alias("_last"))
    return g.select(key, (F.col("_last") == F.col("_top")).alias("consistent"))

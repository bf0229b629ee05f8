"""Row contracts. A row is never dropped for being wrong: it carries the names of what failed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timing import failures, ladder

#: Fixed value: the form of a content hash. \\z, since $ would accept a trailing line break.
HASH_FORM = r"^sha256:[0-9a-f]{64}\z"


def is_hash(c: str) -> Column:
    return F.col(c).rlike(HASH_FORM)


def probability_vector(p: Column, length: int | None = None, tolerance: float = 1e-6) -> Column:
    """The first thing wrong with an array of probabilities, or OK."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    wrong_length = F.lit(False) if length is None else F.size(p) != length
    bad = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    return ladder((p.isNull() | wrong_length, "LENGTH"), (bad, "RANGE"), (F.abs(total - 1) > tolerance, "SUM"), otherwise="OK")


def price_map(prices: str, labels: list[str]) -> Column:
    """Exact labels, every price above zero."""
    keys, vals = F.map_keys(prices), F.map_values(prices)
    return ladder(
        (F.col(prices).isNull(), "MISSING"), (F.array_sort(keys) != F.array(*map(F.lit, sorted(labels))), "LABELS"),
        (~F.forall(vals, lambda x: F.coalesce((x > 0) & ~F.isnan(x), F.lit(False))), "PRICE"), otherwise="OK",
    )


def line_rule(market: str, line: str, line_state: str) -> Column:
    """1X2 markets have no line; others have one, or say why not."""
    one = F.col(market) == "EUROPEAN_1X2"
    return ladder(
        (one & (F.col(line).isNotNull() | (F.col(line_state) != "NOT_APPLICABLE")), "LINE_NOT_ALLOWED"),
        (~one & F.col(line).isNull() & ~F.col(line_state).isin("UNKNOWN", "CONFLICTED"), "LINE_MISSING"), otherwise="OK",
    )


def manual_value(text: str, kind: str) -> Column:
    """A typed-in decimal: odds are above 0, handicap lines may be any number."""
    ok = F.col(text).rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    v = F.when(ok, F.col(text).cast("double"))
    return ladder((v.isNull(), "NOT_A_NUMBER"), ((F.col(kind) == "ODDS") & (v <= 0), "NOT_POSITIVE"), otherwise="OK")


def eligibility(rows: DataFrame, roles: tuple[str, ...], handicap: str, missing_line: Column, other: Column) -> DataFrame:
    """A row for each role: a missing handicap line blocks that role alone, anything else all of them."""
    r = rows.withColumn("role", F.explode(F.array(*map(F.lit, roles))))
    return r.withColumn("eligible", ~(F.coalesce(other, F.lit(False)) | (F.coalesce(missing_line, F.lit(False)) & (F.col("role") == handicap))))


def leakage(samples: DataFrame, identity: str, feature_at: str, cutoff: str, label_at: str, partition: str, match: str) -> DataFrame:
    """One row for each kind of leak and sample: duplicate ids, features after the cutoff, labels up to it, matches in two partitions."""
    dup = samples.groupBy(identity).count().where("count > 1").select(F.lit("DUPLICATE_ID").alias("leak"), F.col(identity).cast("string").alias("item"))
    of_row = failures((F.col(feature_at) > F.col(cutoff), "FEATURE_AFTER_CUTOFF"), (F.col(label_at) <= F.col(cutoff), "LABEL_BEFORE_CUTOFF"))
    own = samples.select(F.explode(of_row).alias("leak"), F.col(identity).cast("string").alias("item"))
    # least against greatest: a match is one row of one aggregate, where distinct partitions would be counted in four
    split = samples.groupBy(match).agg(F.min(partition).alias("_least"), F.max(partition).alias("_most")).where("_least < _most").select(F.lit("MATCH_ACROSS_PARTITIONS").alias("leak"), F.col(match).cast("string").alias("item"))
    return reduce(DataFrame.unionByName, (dup, own, split))


def all_gates(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """rows with each gate as a boolean, and `passed` if all hold; unknown counts as failed."""
    named = rows.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in gates.items()})
    return named.withColumn("passed", reduce(lambda a, b: a & b, (F.col(k) for k in gates)))


def undeclared(given: Column, declared: Column) -> Column:
    """What is wrong with a payload's keys: missing and extra ones."""
    return failures((F.size(F.array_except(declared, given)) > 0, "MISSING"), (F.size(F.array_except(given, declared)) > 0, "UNDECLARED"))


def dangling(refs: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """References that nothing declares."""
    return refs.join(known.select(on).distinct(), on, "left_anti")

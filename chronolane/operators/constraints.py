"""Integrity rules as queries for their violations, and differences of schemas and registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timing import ladder


def differences(expected: DataFrame, found: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """key and MISSING, EXTRA, CHANGED or SAME, by a full outer join."""
    e = expected.select(*key, F.struct(*content).alias("_e"))
    f = found.select(*key, F.struct(*content).alias("_f"))
    kind = ladder((F.col("_f").isNull(), "MISSING"), (F.col("_e").isNull(), "EXTRA"), (~F.col("_e").eqNullSafe(F.col("_f")), "CHANGED"), otherwise="SAME")
    return e.join(f, key, "full_outer").select(*key, kind.alias("difference"))


def violations(rows: DataFrame, identity: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks; a rule is the condition that must not hold, and unknown does not break it."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return rows.select(identity, F.explode(broken).alias("violation"))


def repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values that a column holds more than once."""
    parts = [rows.groupBy(F.col(c).cast("string").alias("value")).count().where("count > 1").select(F.lit(c).alias("field"), "value", F.col("count").alias("n")) for c in columns]
    return reduce(DataFrame.unionByName, parts)


def one_active(rows: DataFrame, key: list[str], active: Column) -> DataFrame:
    """Keys with more than one active row."""
    return rows.groupBy(*key).agg(F.count_if(active).alias("active")).where("active > 1")


def without_approval(rows: DataFrame, approvals: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(approvals.select(*key).distinct(), key, "left_anti")


def guarded_update(old: DataFrame, new: DataFrame, key: str, free: list[str], stamp: str) -> DataFrame:
    """What is wrong with an update: an unknown row, a change outside the free columns, or a stamp that goes back."""
    fixed = [c for c in new.columns if c not in (*free, key, stamp)]
    o = old.select(key, F.struct(*fixed).alias("_o"), F.col(stamp).alias("_s"), F.lit(True).alias("_there"))
    both = new.withColumn("_n", F.struct(*fixed)).join(o, key, "left")
    state = ladder((F.col("_there").isNull(), "UNKNOWN_ROW"), (~F.col("_n").eqNullSafe(F.col("_o")), "FROZEN_COLUMN"), (F.col(stamp) < F.col("_s"), "STAMP_BACKWARDS"), otherwise="OK")
    return both.select(key, state.alias("update_state"))


def ordered_steps(steps: DataFrame, known: DataFrame, by: list[str], position: str, step: str) -> DataFrame:
    """Each step of a history: UNKNOWN, FORWARD if it goes back in order, DUPLICATE, GAP, or OK."""
    w = Window.partitionBy(*by).orderBy(position)
    k = known.select(F.col(step), F.col("place").alias("_place"))
    s = steps.join(k, step, "left").withColumn("_before", F.lag("_place").over(w))
    state = ladder(
        (F.col("_place").isNull(), "UNKNOWN"), (F.col("_place") == F.col("_before"), "DUPLICATE"), (F.col("_place") < F.col("_before"), "FORWARD_REFERENCE"),
        (F.col("_place") > F.coalesce("_before", F.lit(0)) + 1, "GAP"), otherwise="OK",
    )
    return s.withColumn("step_state", state).drop("_place", "_before")


#: What may change of an input before it is frozen.
FREE = ("status", "frozen_at", "immutable", "future_information_leakage", "run_invalid", "tier_a_eligible", "gate_reason", "source_summary", "metadata")


def change_set(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, `old` and `new` (structs of the other columns) and `change`: INSERT, UPDATE, DELETE or SAME, by a full outer join of two images of a table. key is unique in each and not null."""
    rest = [c for c in before.columns if c not in key]
    image = lambda t, name: t.select(*key, F.struct(*rest).alias(name), F.lit(True).alias(f"_in_{name}"))
    both = image(before, "old").join(image(after, "new"), key, "full_outer")
    kind = ladder((F.col("_in_old").isNull(), "INSERT"), (F.col("_in_new").isNull(), "DELETE"), (~F.col("old").eqNullSafe(F.col("new")), "UPDATE"), otherwise="SAME")
    return both.withColumn("change", kind).drop("_in_old", "_in_new")


def append_only(changes: DataFrame) -> DataFrame:
    """changes with `refused`: an append-only table takes no update and no delete."""
    return changes.withColumn("refused", F.when(F.col("change").isin("UPDATE", "DELETE"), F.concat(F.lit("APPEND_ONLY_"), F.col("change"))))


def frozen_guard(changes: DataFrame, boundary: Column, free: tuple[str, ...] = FREE) -> DataFrame:
    """changes with `refused`: the first rule that a change of frozen inputs breaks, and `touched`: the columns that an update may not change but does.

    Rows hold status, immutable, frozen_at and kickoff_at. boundary is the gate through which the change comes.
    """
    fields = changes.schema["new"].dataType.names
    old, new = (lambda c: F.col(f"old.{c}")), (lambda c: F.col(f"new.{c}"))
    update = F.col("change") == "UPDATE"
    touched = F.array_compact(F.array(*(F.when(~old(c).eqNullSafe(new(c)), F.lit(c)) for c in fields if c not in free)))
    closed = lambda image: image("status").isin("FROZEN", "SUPERSEDED")
    out = changes.withColumn("touched", F.when(update, touched).otherwise(F.array().cast("array<string>")))
    why = ladder(
        (F.col("change") == "DELETE", "FROZEN_INPUT_DELETE"), (update & (F.coalesce(old("immutable"), F.lit(False)) | closed(old)), "FROZEN_INPUT_MUTATION"),
        (update & ~boundary.eqNullSafe(F.lit("FREEZE_GATE")), "FROZEN_INPUT_MUTATION_OUTSIDE_GATE"), (update & (F.size("touched") > 0), "FROZEN_INPUT_IDENTITY_FIELDS_ARE_IMMUTABLE"),
        (update & closed(new) & ~F.coalesce(new("immutable"), F.lit(False)), "FROZEN_INPUT_STATUS_REQUIRES_IMMUTABLE"), (update & new("immutable") & new("frozen_at").isNull(), "FROZEN_INPUT_IMMUTABLE_REQUIRES_FROZEN_AT"),
        (update & (new("frozen_at") >= new("kickoff_at")), "FROZEN_INPUT_FREEZE_MUST_PRECEDE_KICKOFF"),
    )
    return out.withColumn("refused", why)


def enforced(changes: DataFrame) -> DataFrame:
    """changes; the job fails at the first that is refused."""
    return changes.withColumn("change", F.when(F.col("refused").isNotNull(), F.raise_error(F.col("refused"))).otherwise(F.col("change")))

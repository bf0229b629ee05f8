"""Evaluation of predicted probabilities, and train-only encoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-15


def log_loss(p: Column, label: Column) -> Column:
    """Mean of -ln of the probability given to the label's class (0-based), floored at 1e-15."""
    return F.avg(-F.log(F.greatest(F.get(p, label), F.lit(FLOOR))))


def brier(p: Column, label: Column) -> Column:
    """Mean over rows of the squared distance to the label's unit vector: 0 to 2."""
    return F.avg(F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == label, 1.0).otherwise(0.0), F.lit(2))), F.lit(0.0), lambda a, x: a + x))


def argmax(p: Column) -> Column:
    """The first index of the largest probability, from 0."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def recalls(rows: DataFrame, by: list[str], label: str, predicted: str, classes: int) -> DataFrame:
    """Support and recall of each declared class; null without support. The macro mean leaves nulls out."""
    cols = []
    for c in range(classes):
        is_class = F.col(label) == c
        cols += [F.count_if(is_class).alias(f"support_{c}"), F.try_divide(F.count_if(is_class & (F.col(predicted) == c)), F.count_if(is_class)).alias(f"recall_{c}")]
    g = rows.groupBy(*by).agg(*cols)
    known = F.array_compact(F.array(*(F.col(f"recall_{c}") for c in range(classes))))
    return g.withColumn("macro", F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)))


def top_two(p: Column, names: list[str]) -> Column:
    """The two most probable classes, ties by name, with 0.5 + p/2 rounded to 8 places as raw confidence."""
    pairs = F.transform(F.arrays_zip(p.alias("p"), F.array(*map(F.lit, names)).alias("n")), lambda z: F.struct((-z["p"]).alias("minus"), z["n"].alias("name")))
    return F.transform(F.slice(F.array_sort(pairs), 1, 2), lambda s: F.struct(s["name"].alias("name"), F.round(0.5 - s["minus"] / 2, 8).alias("confidence")))


def calibration_bins(rows: DataFrame, by: list[str], confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Mean confidence, accuracy and their gap in equal bins of confidence."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).alias("bin")
    g = rows.groupBy(*by, b).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return g.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def prior(rows: DataFrame, label: str) -> DataFrame:
    """Class frequencies: the baseline that ignores features."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def standardised(rows: DataFrame, by: list[str], value: str, train: Column) -> DataFrame:
    """z by the mean and population deviation of the training rows of a group; a deviation of 0 counts as 1."""
    fit = rows.where(train).groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    both = rows.join(fit, by, "left")
    return both.withColumn("z", (F.col(value) - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).drop("mean", "sd")


def encoded(rows: DataFrame, category: str, train: Column) -> DataFrame:
    """code: the category's place from 1 in the sorted training vocabulary; 0 if it is not there."""
    vocabulary = rows.where(train & F.col(category).isNotNull()).select(category).distinct()
    codes = vocabulary.withColumn("code", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(category)))  # one row a category
    return rows.join(codes, category, "left").withColumn("code", F.coalesce("code", F.lit(0)))


def best_candidate(rows: DataFrame, by: list[str], *keys: str) -> DataFrame:
    """The row of each group with the least keys, in order."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*keys)).alias("row")).select(*by, "row.*")

"""User functions on the cluster: predictors by batch, fits by group from parts that add up, checked on the way out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .validation import probability_vector


def predict(rows: DataFrame, predictor: Callable[[pd.DataFrame], list], keep: list[str], length: int) -> DataFrame:
    """keep, probabilities and what is wrong with them (OK if nothing), from a function of a batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keep].assign(probabilities=predictor(batch))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", probabilities array<double>"
    return rows.mapInPandas(run, schema).withColumn("check", probability_vector(F.col("probabilities"), length))


def fit_by(rows: DataFrame, by: list[str], fitter: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int) -> DataFrame:
    """fitter over each group's rows in one frame, for fits that have no parts to add up (`fit_parts` has no bound): a larger group is drawn down to `most` rows by hash, the fit's documented bound."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(*rows.columns))
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most).drop("_i").groupBy(*by).applyInPandas(fitter, schema)


#: Groups whose sums a task holds before it hands them on.
GROUPS = 1 << 14


def fit_parts(rows: DataFrame, by: list[str], partial: Callable[[pd.DataFrame, dict | None], Sequence[float]], width: int, finish: Callable[[np.ndarray, dict | None], dict], schema: str, rounds: int = 1) -> DataFrame:
    """by and the columns of schema: a fit of all rows of each group, from parts that add up.

    partial gives `width` numbers (sufficient statistics, or the terms of a Newton step) of some rows of one
    group; they are summed over all parts, where the rows lie: neither a row nor a group is shuffled whole. finish
    makes the model of a group from its sums. With more rounds, each passes the model of the one before
    to both (null at first) and is written. A group may have any number of rows.
    """
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    keyed, model = rows.withColumn("_g", key), None
    names = [f.split()[0] for f in schema.split(", ")]

    def told(frame: pd.DataFrame) -> dict | None:
        return {n: frame[f"_m_{n}"].iloc[0] for n in names} if f"_m_{names[0]}" in frame else None

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for g, group in batch.groupby("_g", sort=False):
                sums[g] = sums.get(g, 0) + np.asarray(partial(group, told(group)), float)
            if len(sums) > GROUPS:
                yield pd.DataFrame({"_g": list(sums), "_sums": list(sums.values())})
                sums = {}
        if sums:
            yield pd.DataFrame({"_g": list(sums), "_sums": list(sums.values())})

    def models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [finish(np.asarray(s, float), told(batch.iloc[i : i + 1])) for i, s in enumerate(batch["_sums"])]
            yield pd.DataFrame({"_g": batch["_g"], **{n: [m[n] for m in made] for n in names}})

    for _ in range(rounds):
        here = keyed if model is None else keyed.join(model, "_g")
        added = here.mapInPandas(parts, "_g string, _sums array<double>").groupBy("_g").agg(F.array(*(F.sum(F.col("_sums")[i]) for i in range(width))).alias("_sums"))
        added = added if model is None else added.join(model, "_g")
        found = written(added.mapInPandas(models, f"_g string, {schema}"), "models")
        model = found.select("_g", *(F.col(n).alias(f"_m_{n}") for n in names))
    return found.withColumn("_k", F.from_json("_g", rows.select(*by).schema)).select(*(F.col(f"_k.{c}").alias(c) for c in by), *names)

"""Labelled rows to learn from, and small calibration helpers shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(k: int):
    """crc32 of the decimal doc_id, modulo k."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % k


def held_out(k: int):
    """Whether that remainder is 0; it is not for a null doc_id."""
    return F.coalesce(remainder(k) == 0, F.lit(False))


def learned(k: int):
    """Whether that remainder is known and not 0."""
    return F.coalesce(remainder(k) != 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[str, int]]:
    """Up to per_class (text, label) of each label from rows whose remainder by 5 is not 0.

    Ids are drawn from the small label table, then texts are looked up by a broadcast of at most
    2 * per_class ids. A doc_id with two labels, a null label or a null text is left out.
    """
    known = labels.where(F.col(label).isin(0, 1) & (remainder(5) != 0)).groupBy("doc_id").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi")
    picked = None
    for value in (0, 1):
        part = known.where(F.col("lo") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = F.broadcast(picked.select("doc_id", F.col("lo").alias("label")))
    found = docs.select("doc_id", "text").join(picked, "doc_id").where("text is not null").toArrow()
    rows = sorted(zip(found.column("doc_id").to_pylist(), found.column("text").to_pylist(), found.column("label").to_pylist()))
    return [(t, y) for _, t, y in rows]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic fit by Newton steps; the last one is the constant. y may be probabilities."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

"""Quality by compression: dictionaries of good and of bad text, and which of them helps more.

Two zstandard dictionaries are trained on bounded samples of labelled rows. All of a text is
compressed with each, in parts so short that the dictionary counts rather than the text's own
repetitions; the difference of the sizes over the text's bytes, calibrated by a rising curve on
labelled rows that neither dictionary saw, is the score. Null and empty texts have difference 0; repeated rows are
scored each, further columns ignored, and an empty table gives an empty one.
If a label is missing from the training rows, every text scores the share of the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, remainder, training_sample
from .shared import slices

#: Labelled rows of each label to fit on, bytes of a dictionary at most, of the pieces it is trained on, and of the parts compressed.
PER_LABEL, DICTIONARY_BYTES, PIECE, PART = 6000, 512 << 10, 8000, 600
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    at: np.ndarray
    value: np.ndarray

    def compressors(self):
        if not self.good:
            return None
        return tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in (self.good, self.bad))


def differences(texts: list[str], compressors) -> np.ndarray:
    """(bad - good) / bytes of the compressed sizes; above 0 the good dictionary helps more."""
    if compressors is None:
        return np.zeros(len(texts))
    good, bad = (c.compress for c in compressors)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        raw = text.encode()
        gain = 0
        for at in range(0, len(raw), PART):
            part = raw[at : at + PART]
            gain += len(bad(part)) - len(good(part))
        out[i] = gain / max(1, len(raw))
    return out


def pieces(texts: list[str]) -> list[bytes]:
    out = []
    for x in texts:
        raw = x.encode()
        out += [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
    return out


def rising(d: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve that fits y best (pooling of adjacent violators), drawn in by one row of each label."""
    order = np.argsort(d, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted y, weighted d
    for i in order:
        blocks.append([weight[i], weight[i] * y[i], weight[i] * d[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    least = weight.min()
    share = (weight * y).sum() / weight.sum()
    at, value = np.array([b[2] / b[0] for b in blocks]), np.array([(b[1] + least * share) / (b[0] + least) for b in blocks])
    order = np.argsort(at, kind="stable")
    return at[order], np.maximum.accumulate(value[order])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    rows = training_sample(docs, labels, "quality", per_label)
    good, bad = [t for t, y in rows if y == 1], [t for t, y in rows if y == 0]
    share = float(labels.where((remainder(5) != 0) & F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0] or 0.0)
    flat = Model(b"", b"", np.zeros(1), np.array([share]))
    if len(good) < 8 or len(bad) < 8:
        return flat
    apart = [([t for i, t in enumerate(x) if i % 4 == 0], [t for i, t in enumerate(x) if i % 4]) for x in (good, bad)]
    try:
        trained = []
        for _, texts in apart:
            parts = pieces(texts)
            trained.append(zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, parts)) // 4), parts).as_bytes())
    except zstandard.ZstdError:  # too little text for a dictionary
        return flat
    model = Model(*trained, flat.at, flat.value)
    c = model.compressors()
    d = np.concatenate([differences(x[0], c) for x in apart])
    y = np.concatenate((np.ones(len(apart[0][0])), np.zeros(len(apart[1][0]))))
    # weigh the two samples to the share of the labels in all training rows
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    model.at, model.value = rising(d, y, weight)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text)."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.compressors()
        for batch in slices(batches):
            d = differences([x or "" for x in batch.column("text").to_pylist()], c)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.interp(d, model.at, model.value))], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out(5).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(run, rows.select("doc_id", "held_out").schema.add("score", "double"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

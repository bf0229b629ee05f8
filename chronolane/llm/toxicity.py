"""Toxicity by weak supervision.

Sixteen voters look at a whole text: parts of a lexicon (general insults, and words mined from
labelled training rows), parts of a list of word beginnings mined likewise, and patterns of
spelling. Every document's votes are counted by pattern, at most 2^16 of them. A generative model of
the votes, fitted to those counts by expectation-maximisation, gives each voter's rates for toxic
and clean texts; voters that still agree within a class share their weight. Its posteriors label
the training texts, and a linear classifier on words and word beginnings is trained on them. The
classifier gives the score. Null and empty texts score by its constant alone; repeated rows are
scored each, further columns ignored, and an empty table gives an empty one. Without labelled rows of a
class the lexicon's prior weights decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .labelled import held_out, remainder, sigmoid, training_sample
from .shared import give_back, slices

# General insults and threats.
INSULTS = ("idiot", "moron", "stupid", "dumb", "fool", "loser", "clown", "imbecile", "cretin", "jerk")
CONTEMPT = ("scum", "trash", "garbage", "worthless", "pathetic", "disgusting", "filth", "vermin", "subhuman", "despicable")

#: Labelled rows of each label to learn from; buckets of the classifier's weights.
PER_LABEL, BUCKETS = 5000, 1 << 18
#: Lexicon voters by part: mined words, mined beginnings of 4 and of 5 bytes; then patterns.
WORD_PARTS, BEGIN_PARTS = 6, 4
VOTERS = 16
BEGINNINGS = (4, 5, 6, 7)


@dataclass
class Lexicon:
    """Sorted hashes and the voter that each belongs to."""

    hashes: np.ndarray
    voter: np.ndarray

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        found = np.flatnonzero(self.hashes[at] == h)
        return found, self.voter[at[found]]


@dataclass
class Model:
    lexicon: Lexicon
    rates: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float = 0.0


def features(column: pa.Array) -> tuple[list[np.ndarray], textvec.Words, np.ndarray]:
    """Each text's distinct features as hashes, the words, and each word's document.

    Features are words and beginnings, and each of these again as one that comes twice, and as one that comes three times.
    """
    w = textvec.words(column, letters=True)
    kinds = [w.hashes, *(textvec.beginnings(w, k) for k in BEGINNINGS)]
    out = []
    for i in range(len(w)):
        a, b = w.first[i], w.first[i + 1]
        h, n = np.unique(np.concatenate([k[a:b] for k in kinds]), return_counts=True)
        out.append(np.concatenate((h, textvec.mix(h[n > 1] + np.uint64(1)), textvec.mix(h[n > 2] + np.uint64(2)))))
    return out, w, np.repeat(np.arange(len(w)), np.diff(w.first))


def unlike(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One row of each family of near copies with one label, told by their least shingle hashes."""
    kept: dict = {}
    for at in range(0, len(rows), 400):
        part = rows[at : at + 400]
        for row, s in zip(part, textvec.shingle_sets(pa.array([t for t, _ in part], pa.large_string()))):
            kept.setdefault((row[1], tuple(s[:2].tolist())), row)
    return list(kept.values())


def mined(sets: list[np.ndarray], y: np.ndarray, whole: np.ndarray, least: float = 0.01) -> Lexicon:
    """What stands in toxic texts mainly: in at least that share of them, and 40 times as often as in clean ones.

    `whole` holds the hashes of whole words, sorted; other features are beginnings or repetitions.
    """
    voter = {textvec.word_hash(x, True): 10 + (x in CONTEMPT) for x in (*INSULTS, *CONTEMPT)}
    toxic = [s for s, t in zip(sets, y) if t]
    if toxic:
        h, n = np.unique(np.concatenate(toxic), return_counts=True)
        often = (n >= 4) & (n / len(toxic) >= least) & (h > 0)
        h, n = h[often], n[often]
        clean = np.zeros(len(h), np.int64)
        for s, t in zip(sets, y):
            if not t and len(h):
                at = np.searchsorted(h, s)
                at[at == len(h)] = 0
                clean[at[h[at] == s]] += 1
        marks = n / len(toxic) > 40 * (clean + 0.5) / max(1, len(sets) - len(toxic))
        words = np.isin(h, whole, assume_unique=True)
        for k, w in zip(h[marks].tolist(), words[marks].tolist()):
            voter.setdefault(k, k % WORD_PARTS if w else WORD_PARTS + k % BEGIN_PARTS)
    keys = np.array(sorted(voter), np.uint64)
    return Lexicon(keys, np.array([voter[int(k)] for k in keys], np.int64))


def votes(column: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's votes as bits, and its features."""
    sets, w, _ = features(column)
    n = len(w)
    bits = np.zeros((n, VOTERS), bool)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    at, voter = lexicon.hits(np.concatenate(sets) if n else np.zeros(0, np.uint64))
    bits[owner[at], voter] = True
    first = w.first
    texts = [x.as_py() or "" for x in column]
    for i, x in enumerate(texts):
        size = max(1, len(x))
        bits[i, 12] = x.count("!") * 40 > size
        bits[i, 13] = "!!!" in x or "???" in x
        bits[i, 14] = first[i + 1] - first[i] > 0 and x.upper() == x
        bits[i, 15] = " you " in x or "You " in x
    return bits @ (1 << np.arange(VOTERS)), sets


def label_model(patterns: np.ndarray, counts: np.ndarray, share: float, start: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Rates P(vote | class) as (2, VOTERS), weights of the voters, and the share of toxic texts.

    `start` holds first rates, from the labelled rows; the counts of all documents decide.
    """
    v = (patterns[:, None] >> np.arange(VOTERS)) & 1
    rates = start
    share = float(np.clip(share, 0.005, 0.5))
    total = counts.sum()
    for _ in range(rounds):
        post = posterior(v, rates, np.ones(VOTERS), share)
        mass = np.array([((1 - post) * counts).sum(), (post * counts).sum()])
        new = np.stack([((((1 - post) * counts)[:, None] * v).sum(0) + 0.1) / (mass[0] + 1), (((post * counts)[:, None] * v).sum(0) + 0.5) / (mass[1] + 1)])
        share = float(np.clip(mass[1] / max(total, 1), 1e-4, 0.9))
        if np.abs(new - rates).max() < 1e-6:
            rates = new
            break
        rates = new
    # correlation within classes that independence does not explain
    post = posterior(v, rates, np.ones(VOTERS), share)
    shared = np.zeros((VOTERS, VOTERS))
    for mass, rate in (((1 - post) * counts, rates[0]), (post * counts, rates[1])):
        both = (v * mass[:, None]).T @ v / max(mass.sum(), 1)
        spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-6))
        shared = np.maximum(shared, np.abs(both - np.outer(rate, rate)) / np.outer(spread, spread) * (mass.sum() > 20))
    np.fill_diagonal(shared, 0)
    weights = 1 / (1 + np.where(shared > 0.3, np.minimum(shared, 1), 0).sum(0))
    return rates, weights, share


def posterior(v: np.ndarray, rates: np.ndarray, weights: np.ndarray, share: float) -> np.ndarray:
    r = np.clip(rates, 1e-5, 1 - 1e-5)
    on, off = np.log(r[1] / r[0]), np.log((1 - r[1]) / (1 - r[0]))
    return sigmoid((v * on + (1 - v) * off) @ weights + np.log(share / (1 - share)))


#: What a lexicon entry weighs before training, so that it counts where few labelled texts hold it.
BELIEF = 4.0


def train(sets: list[np.ndarray], y: np.ndarray, lexicon: np.ndarray, passes: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """A logistic classifier on hashed features, by AdaGrad over shuffled texts.

    A feature takes part if it is in at least 5 texts and its presence depends on y (chi-square over 25),
    so that a long text's many indifferent words add nothing. Entries of the lexicon always take part.
    """
    index = [np.unique((s % np.uint64(BUCKETS)).astype(np.int32)) for s in sets]
    n, total, toxic = len(index), np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, p in zip(index, y):
        total[i] += 1
        toxic[i] += p
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    chi = (toxic - total * share) ** 2 / np.maximum(total * share * (1 - share) * (1 - total / n), 1e-9)
    use = (total >= 5) & (chi > 25)
    listed = (lexicon % np.uint64(BUCKETS)).astype(np.int64)
    use[listed] = True
    index = [i[use[i]] for i in index]
    w, g, b, gb = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2), float(np.log(share / (1 - share))), 1e-2
    w[listed] = BELIEF
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(n):
            f = index[i]
            e = float(sigmoid(w[f].sum() + b)) - y[i]
            if abs(e) < 1e-3:
                continue
            g[f] += e * e
            w[f] -= 0.5 * e / np.sqrt(g[f])
            gb += e * e
            b -= 0.5 * e / np.sqrt(gb)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    rows = unlike(training_sample(docs, labels, "toxic", per_label))
    label = np.array([y for _, y in rows], int)
    chunks = [pa.array([t for t, _ in rows[at : at + 400]], pa.large_string()) for at in range(0, len(rows), 400)]
    del rows
    sets, whole = [], np.zeros(0, np.uint64)
    for chunk in chunks:
        found, w, _ = features(chunk)
        sets += found
        whole = np.union1d(whole, w.hashes)
    lexicon = mined(sets, label, whole)
    del whole

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << VOTERS, np.int64)
        for batch in slices(batches):
            seen += np.bincount(votes(batch.column("text"), lexicon)[0], minlength=1 << VOTERS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["pattern", "n"])

    counted = docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    share = labels.where((remainder(5) != 0) & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0] or 0.0
    seen = [(votes(chunk, lexicon)[0][:, None] >> np.arange(VOTERS)) & 1 for chunk in chunks]
    cast = np.concatenate(seen) if seen else np.zeros((0, VOTERS), int)
    start = np.stack([(cast[label == y].sum(0) + 0.01 + 0.09 * y) / ((label == y).sum() + 1) for y in (0, 1)])
    rates, trust, share = label_model(counted.column("pattern").to_numpy(), counted.column("n").to_numpy(), share, start)
    y = posterior(cast, rates, trust, share)
    weights, constant = train(sets, y, lexicon.hashes) if len(y) else (np.zeros(BUCKETS), float(np.log(max(share, 1e-4) / (1 - share))))
    del sets, seen, cast, chunks
    give_back()
    return Model(lexicon, rates, weights, constant)


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: Model | None = None) -> DataFrame:
    """The columns `keep`, held_out, score and predicted for every row of docs(doc_id, text)."""
    model = model or fit(docs, labels)
    told = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.constant))  # BUCKETS floats
    names = [*keep, "held_out", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, constant = told.value
        for batch in slices(batches):
            sets, _, _ = features(batch.column("text"))
            z = np.array([weights[(s % np.uint64(BUCKETS)).astype(np.int64)].sum(dtype=np.float64) for s in sets]) + constant
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("held_out"), pa.array(sigmoid(z))], names)

    rows = docs.withColumn("held_out", held_out(5)).select(*dict.fromkeys((*keep, "held_out", "text")))
    out = rows.mapInArrow(run, rows.select(*keep, "held_out").schema.add("score", "double"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below 0.5, with all their columns. Null texts count as empty and stay null."""
    model = fit(docs, labels)
    told = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.constant))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, constant = told.value
        for batch in slices(batches):
            sets, _, _ = features(batch.column("text"))
            z = np.array([weights[(s % np.uint64(BUCKETS)).astype(np.int64)].sum(dtype=np.float64) for s in sets]) + constant
            yield batch.filter(pa.array(z < 0))

    return docs.mapInArrow(run, docs.schema)

"""Scoring text with n-grams as a weighted backoff automaton.

Tokens are the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end per text. Counts come from
every text whose crc32(doc_id) modulo 10 is not 0.

Base: each token's smoothed share, log10((c + 0.1) / (N + 0.1 (V + 1))), c over all words, exactly.

Model: orders 3, 2 and 1, the base at the root. The states are the contexts that were counted: pairs
and single words. A state's arc carries log10 of (c + mass * share at the shorter context) / (all + mass), its
failure arc leads to the shorter context and carries log10 of mass / (all + mass), so a state's arcs and
what its failure arc reaches add up to 1. All counted n-grams are arcs, those seen once too.

The automaton of a large corpus is held by no task. The state before a token is known from the two
words before it, so the traversal of a text needs the counts of its own n-grams alone. Texts are read
once, as packed codes of their tokens, and gathered into units that are written; each unit asks for its
distinct n-grams, packed by bucket, with its own counts; a bucket adds up what all units have of an
n-gram and answers each. Of the answers a unit builds its part of the automaton, all states and arcs that
its texts can meet, and traverses its texts with it. A frequent n-gram is one entry of a unit, so none
is hot. The RANKED most counted words are spelled by rank, others by hash; that decides the bytes sent,
not the scores.

Null and empty texts have the end alone; further columns are ignored and an empty table gives an empty
one; with no training text every token has the share of an unseen one. Repeated rows are scored each and
learned from each. A null doc_id has no remainder: it is scored, not held out and not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textvec
from .labelled import held_out, learned
from .shared import give_back, most_counted, slices, written

#: What the shorter context counts for, in tokens, at a state of one word and at one of two (chosen on training rows: what the others of them give those with remainder 1); and the root's smoothing.
MASS, SMOOTH = (16000.0, 8.0), 0.1
#: Tokens of a unit, and n-grams of a bucket, about: what a Python task holds at once.
UNIT_TOKENS, BUCKET_KEYS = 1 << 20, 1 << 20
#: Tokens that a lane of the traversal walks; a longer text is walked by several lanes, each from the state its first two words before it lead to.
LANE = 512
#: Words that are told to the tasks with their rank (12 bytes each).
RANKED = 1 << 22
RARE = np.uint64(1 << 63)
#: Counts that a task gathers before it hands them on.
GATHERED = 1 << 21
END = np.uint64(0x5EED_0F_7E47)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' tokens, each text's end included, and each text's first (one more entry at the end)."""
    w = textvec.words(column)
    n = len(w)
    first = w.first + np.arange(n + 1)
    out = np.empty(first[-1], np.uint64)
    place = np.ones(len(out), bool)
    place[first[1:] - 1] = False
    out[place] = w.hashes
    out[~place] = END
    return out, first


def _counted(docs: DataFrame, keys) -> DataFrame:
    """Counts of the int64 keys that `keys(batch)` gives, as (k, c), summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[at : at + (1 << 16)]), pa.array(c[at : at + (1 << 16)])], ["k", "c"])

        for batch in slices(batches):
            held.append(keys(batch))
            size += len(held[-1])
            if size > GATHERED:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def _gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of what a stands for, then b."""
    return textvec.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def pack(x: np.ndarray, press: zstandard.ZstdCompressor | None = None) -> bytes:
    """64-bit integers as compressed planes of bytes."""
    return (press or zstandard.ZstdCompressor(level=1)).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T))


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


@dataclass
class Unit:
    """The tokens of some texts as codes: each one's place in its text, and each text's first (one more entry at the end).

    A code is a word's rank, or its hash with the highest bit set.
    """

    codes: np.ndarray
    place: np.ndarray
    first: np.ndarray

    def grams(self, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of an order's n-grams: the positions where one ends, the entry of each, and for each entry such a position.

        Entries are the distinct n-grams by bucket, the highest bits of their hash, and by their first word's rank.
        """
        at = np.flatnonzero(self.place >= order - 1)
        words = [self.codes[at - i] for i in range(order - 1, -1, -1)]
        keys, first = hashed(words), np.minimum(words[0], np.uint64((1 << 21) - 1))
        bucket, rest = keys >> np.uint64(64 - bits), keys << np.uint64(bits)
        short = bucket << np.uint64(64 - bits) | first << np.uint64(43 - bits) | rest >> np.uint64(bits + 21)
        by = np.argsort(short)
        short, known = short[by], keys[by]
        new = known[1:] != known[:-1]
        if (new != (short[1:] != short[:-1])).any():  # two n-grams share the shortened key: sort by the whole one
            by = np.lexsort((keys, first, bucket))
            known = keys[by]
            new = known[1:] != known[:-1]
        new = np.concatenate((np.ones(min(1, len(by)), bool), new))
        entry = np.empty(len(by), np.int64)
        entry[by] = np.cumsum(new) - 1
        return at, entry, at[by[new]]


def hashed(words: list[np.ndarray]) -> np.ndarray:
    key = textvec.mix(words[0])
    for w in words[1:]:
        key = _gram(key, w)
    return key


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values of x, and of each element the place of its value."""
    by = np.argsort(x)
    x = x[by]
    new = np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))
    entry = np.empty(len(x), np.int64)
    entry[by] = np.cumsum(new) - 1
    return x[new], entry


def coded(h: np.ndarray, top: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The codes of words' hashes; top is sorted."""
    words, entry = distinct(h)
    codes = words | RARE
    if len(top):
        at = np.searchsorted(top, words)
        at[at == len(top)] = 0
        codes = np.where(top[at] == words, rank[at].astype(np.uint64), codes)
    return codes[entry]


def gathered(batches: Iterator[pa.RecordBatch], top: np.ndarray, rank: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """One row for each unit of about `most` tokens (or one longer text): lists of its rows' columns, their sizes, and the packed codes of all their tokens."""
    columns: list[list] = []
    sizes: list[int] = []
    parts: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        kinds = [*schema.types, pa.int64()]
        lists = [pa.array([x], pa.list_(k)) for x, k in zip([*columns, sizes], kinds)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([pack(np.concatenate(parts))], pa.binary())], [*schema.names, "sizes", "codes"])

    held = 0
    for batch in slices(batches):
        h, first = tokens(batch.column("text"))
        codes, rest = coded(h, top, rank), batch.drop_columns(["text"])
        schema, columns = rest.schema, columns or [[] for _ in rest.schema.names]
        a = 0
        while a < len(batch):  # as many texts as the unit still holds
            b = max(int(np.searchsorted(first, first[a] + most - held, side="right")) - 1, a + (held == 0))
            for into, c in zip(columns, rest.columns):
                into.extend(c.slice(a, b - a).to_pylist())
            sizes.extend(np.diff(first[a : b + 1]).tolist())
            parts.append(codes[first[a] : first[b]])
            held += int(first[b] - first[a])
            if b < len(batch) or held >= most:
                yield flush()
                columns, sizes, parts, held = [[] for _ in rest.schema.names], [], [], 0
            a = b
    if sizes:
        yield flush()


def unit_of(sizes: list[int], codes: bytes) -> Unit:
    size = np.array(sizes, np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    return Unit(unpack(codes), np.arange(first[-1]) - np.repeat(first[:-1], size), first)


@dataclass
class Automaton:
    """State 0 is the root, 1 to W the single words, then the pairs. Keys are state * (W + 1) + word; word 0 is any unseen one."""

    words: np.ndarray  # sorted hashes; word i has id ids[i] = i + 1
    keys: np.ndarray  # of the arcs, sorted
    weights: np.ndarray
    targets: np.ndarray
    back: np.ndarray  # each state's failure arc: weight
    fail: np.ndarray  # and target
    pairs: np.ndarray  # the pairs that are states, sorted, in base W + 1

    def word_ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.searchsorted(self.words, h)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == h, at + 1, 0)

    def arcs(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state * (len(self.words) + 1) + word
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), bool)

    def state_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The state after words a, b: the pair where it was counted, else the single word b."""
        key = a * (len(self.words) + 1) + b
        j = np.searchsorted(self.pairs, key)
        j[j == len(self.pairs)] = 0
        return np.where(self.pairs[j] == key, len(self.words) + 1 + j, b) if len(self.pairs) else b

    def lanes(self, word: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each lane begins and ends, and the state it begins in; a text has one for each `most` tokens."""
        count = -(-np.diff(first) // most)
        of = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        begin = first[:-1][of] + nth * most
        state = np.zeros(len(of), np.int64)
        later = np.flatnonzero(nth)
        state[later] = self.state_after(word[begin[later] - 2], word[begin[later] - 1])
        return begin, np.minimum(begin + most, first[1:][of]), state

    def traverse(self, word: np.ndarray, root: np.ndarray, first: np.ndarray, lane: int = LANE) -> np.ndarray:
        """The log10 probability of each text, from left to right: root holds each token's weight at the root. `lane` is at least 2."""
        begin, end, state = self.lanes(word, first, lane)
        lengths = end - begin
        order = np.argsort(-lengths, kind="stable")
        begin, lengths, state = begin[order], lengths[order], state[order]
        total = np.zeros(len(order))
        steps = int(lengths[0]) if len(lengths) else 0
        alive = np.searchsorted(-lengths, -np.arange(steps), side="left")
        for t in range(steps):
            n = alive[t]
            at = begin[:n] + t
            w, s = word[at], state[:n]
            gain, to = np.zeros(n), np.zeros(n, np.int64)
            todo = np.arange(n)
            while len(todo):
                at_root = s == 0
                done = todo[at_root]
                gain[done] += root[at[done]]
                to[done] = w[done]
                todo, s = todo[~at_root], s[~at_root]
                i, hit = self.arcs(s, w[todo])
                gain[todo[hit]] += self.weights[i[hit]]
                to[todo[hit]] = self.targets[i[hit]]
                todo, s = todo[~hit], s[~hit]
                gain[todo] += self.back[s]
                s = self.fail[s]
            total[:n] += gain
            state[:n] = to
        out = np.empty(len(order))
        out[order] = total
        of = np.repeat(np.arange(len(first) - 1), -(-np.diff(first) // lane))
        return np.bincount(of, out, len(first) - 1)


def build(words: np.ndarray, word_counts: np.ndarray, root: np.ndarray, pairs, triples) -> Automaton:
    """words hold their hashes; pairs are (sorted keys in base W + 1 of word ids, counts), triples (place of their first pair, last word, counts, place of their last pair); root holds the words' shares.

    Every pair that begins a triple is counted, every pair that ends one, and every word of a pair. Each counted
    word and pair is a state, those that no arc leaves too: their failure arcs have to be paid.
    """
    base = len(words) + 1
    counts1, p1 = np.concatenate(([0], word_counts)).astype(float), np.concatenate(([0.0], root))
    k2, c2 = pairs
    u, w = k2 // base, k2 % base
    share2 = (c2 + MASS[0] * p1[w]) / (counts1[u] + MASS[0])
    where, z, c3, shorter = triples
    share3 = (c3 + MASS[1] * share2[shorter]) / (c2[where] + MASS[1])
    k3 = (base + where) * base + z
    by = np.argsort(k3)  # all of them are above the pairs'
    weights, targets = np.log10(np.concatenate((share2, share3[by]))), base + np.concatenate((np.arange(len(k2)), shorter[by]))
    fail = np.concatenate((np.zeros(base, np.int64), w))
    back = np.log10(np.concatenate([m / (c + m) for c, m in zip((counts1, c2), MASS)]))
    return Automaton(words, np.concatenate((k2, k3[by])), weights, targets, back, fail, k2)


def unit_automaton(ones, twos, threes, ends2: np.ndarray, total: float) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """The part of the automaton that a unit's texts can meet, each token's word id (0: never counted), and its weight at the root.

    Each order is given as (entry of each position, a position of each entry, count of each entry); ends2 are the positions of pairs.
    """
    entry, _, c1 = ones
    ids = np.where(c1 > 0, np.cumsum(c1 > 0), 0)
    word, share = ids[entry], (c1 + SMOOTH) / total
    base = int(ids.max(initial=0)) + 1

    entry2, at, c2 = twos
    counted = np.flatnonzero(c2 > 0)
    key = word[at[counted] - 1] * base + word[at[counted]]
    by = np.argsort(key)
    rank = np.full(len(c2), -1)
    rank[counted[by]] = np.arange(len(by))
    pairs = key[by], c2[counted[by]]
    ended = np.full(len(word), -1)  # the place of the pair that ends at a position
    ended[ends2] = rank[entry2]
    _, at, c3 = threes
    at, c3 = at[c3 > 0], c3[c3 > 0]
    machine = build(np.arange(1, base, dtype=np.uint64), c1[c1 > 0], share[c1 > 0], pairs, (ended[at - 1], word[at], c3, ended[at]))
    return machine, word, np.log10(share)[entry]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs(doc_id, text)."""
    learn = docs.where(learned(10)).select("text")
    counts = written(_counted(learn, lambda b: tokens(b.column("text"))[0].view(np.int64)), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top, often = most_counted(counts, RANKED)
    rank = np.empty(len(top), np.uint32)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(top))
    by_hash = np.argsort(top.view(np.uint64))
    ranked = docs.sparkSession.sparkContext.broadcast((top.view(np.uint64)[by_hash], rank[by_hash]))
    total, unit_tokens, lane = n + SMOOTH * (v + 1), UNIT_TOKENS, LANE
    known = docs.select("doc_id", held_out(10).alias("held_out"), learned(10).alias("learned"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = ", ".join([*(f"{f.name} array<{f.dataType.simpleString()}>" for f in known.schema if f.name != "text"), "sizes array<long>", "codes binary"])
    units = written(known.mapInArrow(lambda batches: gathered(batches, *ranked.value, unit_tokens), kinds).withColumn("unit", F.monotonically_increasing_id()), "units")
    held = units.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(4, int(2 * held // BUCKET_KEYS).bit_length())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, learns, sizes, codes in zip(*(batch.column(c).to_pylist() for c in ("unit", "learned", "sizes", "codes"))):
                yield asked(unit, unit_of(sizes, codes), np.repeat(np.array(learns, float), sizes))
        give_back()

    def asked(unit: int, part: Unit, learns: np.ndarray) -> pa.RecordBatch:
        rows: tuple[list, list, list] = ([], [], [])
        for order in (1, 2, 3):
            at, entry, some = part.grams(order, bits)
            own = np.bincount(entry, learns[at], len(some)).astype(np.int64)
            words = [part.codes[some - i] for i in range(order - 1, -1, -1)]
            cuts = np.searchsorted(hashed(words) >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[i], cuts[i + 1]
                spelled = np.concatenate([np.diff(words[0][a:b], prepend=np.uint64(0)), *(w[a:b] for w in words[1:])])
                for column, x in zip(rows, ((order << bits) + i, pack(spelled), pack(own[a:b]))):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array([unit] * len(rows[0]), pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["unit", "bucket", "keys", "own"])

    def answer(table: pa.Table) -> pa.Table:
        order = table.column("bucket")[0].as_py() >> bits
        asked = []
        for x in table.column("keys").to_pylist():
            first, *rest = np.split(unpack(x), order)
            asked.append(hashed([np.cumsum(first, dtype=np.uint64), *rest]))
        own = np.concatenate([unpack(x) for x in table.column("own").to_pylist()]).astype(float)
        known, entry = distinct(np.concatenate(asked))
        sums = np.bincount(entry, own, len(known)).astype(np.int64)[entry]
        ends = np.cumsum([len(x) for x in asked])[:-1]
        return pa.table([table.column("unit"), table.column("bucket"), pa.array([pack(np.ascontiguousarray(x)) for x in np.split(sums, ends)], pa.binary())], ["unit", "bucket", "counts"])

    def read(table: pa.Table, answers: pa.Table) -> pa.Table:
        unit, answers = {c: table.column(c)[0].as_py() for c in table.column_names}, answers.sort_by("bucket")
        part = unit_of(unit["sizes"], unit["codes"])
        of, packed = answers.column("bucket").to_numpy() >> bits, answers.column("counts").to_pylist()
        grams = []
        for order in (1, 2, 3):
            _, entry, some = part.grams(order, bits)
            found = np.concatenate([np.zeros(0, np.uint64), *(unpack(packed[i]) for i in np.flatnonzero(of == order).tolist())]).astype(np.int64)
            grams.append((entry, some, found))
        machine, word, root = unit_automaton(*grams, np.flatnonzero(part.place > 0), total)
        start, size = part.first[:-1], np.diff(part.first)
        base, known = np.add.reduceat(root, start), np.add.reduceat((word > 0).astype(np.int64), start)
        return pa.table([pa.array(unit["doc_id"], schema_doc_id), pa.array(unit["held_out"]), pa.array(size), pa.array(known), pa.array(np.full(len(size), n)), pa.array(base), pa.array(machine.traverse(word, root, part.first, lane))], schema.names)

    schema = known.select("doc_id", "held_out").schema
    schema_doc_id = to_arrow_type(schema["doc_id"].dataType)
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    asks = units.select("unit", "learned", "sizes", "codes").mapInArrow(ask, "unit long, bucket long, keys binary, own binary")
    answers = asks.groupBy("bucket").applyInArrow(answer, "unit long, bucket long, counts binary")
    return units.drop("learned").groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(read, schema)

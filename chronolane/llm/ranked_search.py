"""Ranked lexical search by sort-based accumulation: every document is scored for each item of a query set.

Terms are the maximal `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of the whole text, only A-Z lower-cased. One pass
over the texts leaves what the items ask of them: a document's length and, of terms that occur in
items, the term's number and count. Counts over all of it give each term's weight.

A task then works through its documents some at a time: a document's terms become impacts, each impact
is repeated for the items that hold its term, and the item-document-impact arrays are concatenated,
sorted by their packed keys (item high, document low, 16 bits a pass; the low half is in order as it
comes) and summed run by run (reduceat). Sums that may be among an item's best go through a heap of that
item. All terms of a document are in one task, so sums are whole there and only each task's best are
shuffled, by ranges of items.

The items are a stated query set against all rows. They are taken in blocks of about BLOCK_BYTES of
text and ITEMS items, each block a pass of its own, so what tasks are told does not grow with their number.

A null text has no terms. Rows count each, so repeated rows are ranked each; at equal scores rows
without a doc_id come last. Rows of one item_id are one item, whose terms add up. Items without terms,
an empty query set and an empty table give no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, texts, written

BLOCK_BYTES, ITEMS = 16 << 20, 1 << 15
#: Bytes of text that are split into words at once, and impacts that are sorted at once.
PIECE, SORTED = 1 << 20, 1 << 18
#: Separators become blanks and A-Z a-z; bytes above 127 belong to characters that are no separators.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Stands between texts; no byte of UTF-8.
_BETWEEN = b"\xff"


def pieces(data: bytes, limit: int = PIECE) -> Iterator[list[bytes]]:
    """The words of folded data, from pieces of about `limit` bytes."""
    start = 0
    while start < len(data):
        end = data.find(b" ", start + limit) if start + limit < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def terms_of(text: str) -> Counter:
    return Counter(w for words in pieces(text.encode().translate(_FOLD)) for w in words)


@dataclass
class Items:
    """A block of the query set: a number for each term, and each term's items with how often they hold it."""

    numbers: dict[bytes, int]
    ids: list
    first: np.ndarray  # of each term, into items and times (one more entry at the end)
    items: np.ndarray
    times: np.ndarray


def items_of(rows: pa.Table) -> Items:
    """From item_id and text of a block's rows."""
    held: dict = {}
    for item, text in zip(rows.column("item_id").to_pylist(), texts(rows)):
        held.setdefault(item, Counter()).update(terms_of(text))
    ids = sorted(held, key=lambda i: (i is None, i))
    found: dict[bytes, list] = {}
    for k, i in enumerate(ids):
        for term, times in held[i].items():
            found.setdefault(term, []).append((k, times))
    flat = np.array([x for each in found.values() for x in each], np.int64).reshape(-1, 2)
    small = np.uint16 if len(ids) <= 1 << 16 else np.uint32
    return Items({t: k for k, t in enumerate(found)}, ids, np.cumsum([0, *map(len, found.values())]), flat[:, 0].astype(small), flat[:, 1])


def postings(docs: DataFrame, numbers) -> DataFrame:
    """doc_id, n (terms with repeats), and the numbers and counts of the known terms, of every row of docs(doc_id, text). numbers: a broadcast dict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = numbers.value.get, len(numbers.value)
        for batch in slices(batches):
            folded = (b" " + _BETWEEN + b" ").join(t.encode().translate(_FOLD) for t in texts(batch))
            n, done, keys = np.zeros(len(batch), np.int64), 0, []
            for words in pieces(folded):
                known = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                border = np.fromiter(map(_BETWEEN.__eq__, words), bool, len(words))
                doc = done + np.cumsum(border)
                n += np.bincount(doc[~border], minlength=len(n))
                keys.append((doc * size + known)[known >= 0])
                done = int(doc[-1]) if len(doc) else done
            keys, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            ends = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys % max(size, 1), counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def impacts(weights: np.ndarray, term: np.ndarray, count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights[term] * ((1_000_000_000 * count) // (1000 * count + 12 * m))


def accumulate(item: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (item, doc) with their sums. doc does not fall, so of the packed keys only the half of the items is left to sort."""
    order = np.argsort(item, kind="stable")  # numpy sorts 16 bits by radix
    packed = item[order].astype(np.int64) << 32 | doc[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(packed)), bool), packed[1:] != packed[:-1])))
    sums = np.add.reduceat(impact[order], new) if len(new) else impact[:0]
    return packed[new] >> 32, packed[new] & 0xFFFFFFFF, sums


class Best:
    """A heap of the k best (score, known, -doc_id) for each item."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, known: np.ndarray, doc_id: np.ndarray) -> None:
        may = np.flatnonzero(score >= self.least[item])
        for i, *entry in zip(item[may].tolist(), score[may].tolist(), known[may].tolist(), (-doc_id[may]).tolist()):
            heap, entry = self.heaps[i], tuple(entry)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                continue
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def best_of_task(found: DataFrame, block, n: int, length: int, k: int) -> DataFrame:
    """item_id, doc_id and score of each task's k best for each item; block: a broadcast (Items without numbers, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = block.value
        degree, best = np.diff(items.first), Best(len(items.ids), k)
        for batch in batches:
            lists = batch.column("terms")
            at = lists.offsets.to_numpy().astype(np.int64)
            term, count = (batch.column(c).values.to_numpy()[at[0] : at[-1]].astype(np.int64) for c in ("terms", "counts"))
            at -= at[0]
            m = 75 + (25 * batch.column("n").to_numpy() * n) // length
            impact = impacts(weights, term, count, np.repeat(m, np.diff(at)))
            ids, known = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            grown = np.concatenate(([0], np.cumsum(degree[term])))[at]  # impacts before each document
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(grown, grown[a] + SORTED, side="right")) - 1)
                some = slice(at[a], at[b])
                times = degree[term[some]]
                of = np.repeat(np.arange(len(times)), times)
                entry = np.arange(len(of)) + np.repeat(items.first[term[some]] - np.cumsum(times) + times, times)
                doc = np.repeat(np.arange(a, b), np.diff(at[a : b + 1]))[of]
                item, doc, score = accumulate(items.items[entry], doc, impact[some][of] * items.times[entry])
                best.add(item, score, known[doc], ids[doc])
                a = b
        rows = [(items.ids[i], -neg if known else None, score) for i, heap in enumerate(best.heaps) for score, known, neg in heap]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return found.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score: for each item of benchmark(item_id, text) its k best rows of docs(doc_id, text)."""
    spark = docs.sparkSession
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    rows, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks, out = max(-(-rows // ITEMS), -(-size // BLOCK_BYTES)), None
    for b in range(blocks):
        items = items_of(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow())  # one block
        told = spark.sparkContext.broadcast(items.numbers)
        found = written(postings(docs, told), "postings")
        n, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        counted = found.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row a term of the block
        df = np.zeros(len(items.numbers), np.int64)
        df[counted.column("term").to_numpy()] = counted.column("count").to_numpy()
        weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        items.numbers = {}
        best = best_of_task(found, spark.sparkContext.broadcast((items, weights)), n, max(1, length), k)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = written(out, "best").repartitionByRange("item_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: Every document against every item.
_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term"
SEARCH_SQL = f"""
with r as (select row_number() over () as row, doc_id, text from documents),
d as (select row, doc_id, term, count(*) as tf from (select row, doc_id, {_TERMS} from r) group by all),
l as (select row, cast(sum(tf) as bigint) as n from d group by row),
g as (select count(*) as docs, cast(sum(n) as bigint) as length from l),
q as (select item_id, term, count(*) as times from (select item_id, {_TERMS} from benchmark) group by all),
w as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as weight from d, g where term in (select term from q) group by term),
s as (select item_id, d.row, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) as bigint) as score
  from q join w on q.term = w.term join d on d.term = q.term join l on l.row = d.row, g group by item_id, d.row, doc_id),
k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as int) as rank, doc_id, score from s where score > 0)
select * from k where rank <= 20
"""

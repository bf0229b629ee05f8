"""Token ids as one wavelet matrix per shard.

A shard is one compressed file: a header, the documents' lengths, and for each bit of the ids, from
the highest down, a plane of bits with the number of zeros. Before each lower plane the ids are
stably parted by the plane above. Block counts of ones, made on opening, give rank; binary search
over ranks gives select. Access, counting and lookup of occurrences read the planes alone.

Null and empty texts have the end id alone; rows of one doc_id are neighbours, in the order of their
texts; further columns are ignored, and an empty table has no shard.

Shards hold ranges of ascending doc_id and are written by Spark as rows (shard, first document,
length, payload) to the shared folder, so a lost task is simply run again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec
from .shared import slices, written

MAGIC = b"WVM1"
BLOCK = 512
#: Bytes of encoded fragments that a worker keeps; more than elsewhere, as encoding is most of the work here.
KEPT = 192 << 20
#: Tokens after which a shard is closed, at the next document's end.
SHARD_TOKENS = 1 << 20


def build(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of a shard: ids of all its documents, and each one's number of ids."""
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    planes, zeros = [], []
    for level in range(levels - 1, -1, -1):
        ones = (x & x.dtype.type(1 << level)) != 0
        planes.append(np.packbits(ones).tobytes())
        z = len(x) - int(np.count_nonzero(ones))
        zeros.append(z)
        parted = np.empty_like(x)
        np.compress(~ones, x, out=parted[:z])
        np.compress(ones, x, out=parted[z:])
        x = parted
    body = lengths.astype("<u4").tobytes() + np.array(zeros, "<u4").tobytes() + b"".join(planes)
    packed = zstandard.ZstdCompressor(level=1).compress(body)
    return MAGIC + struct.pack("<IIBI", len(ids), len(lengths), levels, zlib.crc32(packed)) + packed


class Shard:
    """Reads a shard's file."""

    def __init__(self, file: bytes):
        self.n, docs, self.levels, crc = struct.unpack_from("<IIBI", file, 4)
        packed = file[4 + struct.calcsize("<IIBI") :]
        if file[:4] != MAGIC or zlib.crc32(packed) != crc:
            raise ValueError("not a wavelet shard, or damaged")
        body = zstandard.ZstdDecompressor().decompress(packed)
        self.lengths = np.frombuffer(body, "<u4", docs)
        self.zeros = np.frombuffer(body, "<u4", self.levels, docs * 4).astype(np.int64)
        at, size = (docs + self.levels) * 4, (self.n + 7) // 8
        self.planes = [np.frombuffer(body, np.uint8, size, at + i * size) for i in range(self.levels)]
        self._ranks: dict[int, np.ndarray] = {}

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        if level not in self._ranks:
            bits = np.unpackbits(self.planes[level])
            blocks = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
            self._ranks[level] = np.concatenate(([0], np.cumsum(blocks)))
        start = i // BLOCK
        rest = np.unpackbits(self.planes[level][start * BLOCK // 8 : (i + 7) // 8])[: i - start * BLOCK]
        return int(self._ranks[level][start]) + int(rest.sum())

    def _step(self, level: int, bit: int, i: int) -> int:
        ones = self._ones(level, i)
        return int(self.zeros[level]) + ones if bit else i - ones

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            bit = int(self.planes[level][i >> 3] >> (7 - (i & 7))) & 1
            value = value << 1 | bit
            i = self._step(level, bit, i)
        return value

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        lo, hi = 0, upto
        for level in range(self.levels):
            bit = token >> (self.levels - 1 - level) & 1
            lo, hi = self._step(level, bit, lo), self._step(level, bit, hi)
        return lo, hi

    def rank(self, token: int, upto: int | None = None) -> int:
        """Occurrences of token before position upto; in the whole shard without it."""
        if token >> self.levels or token < 0:
            return 0
        lo, hi = self._range(token, self.n if upto is None else upto)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0), or -1."""
        if k < 0 or k >= self.rank(token):
            return -1
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.rank(token, mid) > k else (mid, hi)
        return lo

    def read(self) -> np.ndarray:
        """All ids, in order."""
        x = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            z, back = int(self.zeros[level]), np.empty_like(x)
            back[np.flatnonzero(~ones)] = x[:z]
            back[np.flatnonzero(ones)] = x[z:] | x.dtype.type(1 << (self.levels - 1 - level))
            x = back
        return x


def write_shards(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Writes docs(doc_id, text) as shards and returns their table: shard_at (first doc_id), part, seq, doc_ids, n_tokens, payload.

    Null texts have the end id alone; rows of one doc_id keep together in an order of their text. A
    null doc_id sorts first. An empty table has no shard.
    """
    spark = docs.sparkSession
    # as many ranges as the scan has splits, twice: told by the plan, without reading the texts
    n = 2 * max(spark.sparkContext.defaultParallelism, docs.select("doc_id").rdd.getNumPartitions())
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, KEPT)
        end = np.array([end_id], c.dtype)
        held: list = []
        state = {"part": None, "seq": 0, "size": 0}

        def close():
            rows, state["seq"] = list(held), state["seq"] + 1
            held.clear()
            state["size"] = 0
            lengths = np.array([len(x) for _, x in rows])
            ids = np.concatenate([x for _, x in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([state["part"]], pa.int32()), pa.array([state["seq"]], pa.int32()), pa.array([[d for d, _ in rows]], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([build(ids, lengths)], pa.binary())],
                ["part", "seq", "doc_ids", "n_tokens", "payload"],
            )

        for batch in slices(batches, limit=1 << 20):
            encoded = c.encode([x or "" for x in batch.column("text").to_pylist()])
            for part, doc, ids in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), encoded):
                if part != state["part"]:
                    if held:
                        yield close()
                    state |= {"part": part, "seq": 0}
                held.append((doc, np.concatenate((ids, end))))
                state["size"] += len(ids) + 1
                if state["size"] >= SHARD_TOKENS:
                    yield close()
        if held:
            yield close()

    return written(ordered.mapInArrow(shard, "part int, seq int, doc_ids array<long>, n_tokens long, payload binary"), "shards")


def _starts(sizes: DataFrame, by: list[str], order: str) -> DataFrame:
    """sizes with start: the sizes before each row of its group."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shards' files alone."""
    # where each shard begins: sums of a thousand ranges, then of ranges, then of shards, so that no window holds many rows
    keyed = shards.select((F.col("part") / 1000).cast("int").alias("block"), "part", "seq", "n_tokens")
    blocks = _starts(keyed.groupBy("block").agg(F.sum("n_tokens").alias("size")), [], "block")
    parts = _starts(keyed.groupBy("block", "part").agg(F.sum("n_tokens").alias("size")), ["block"], "part").withColumnRenamed("start", "part_start")
    offsets = _starts(keyed.select("block", "part", "seq", F.col("n_tokens").alias("size")), ["block", "part"], "seq").withColumnRenamed("start", "seq_start")
    offsets = offsets.join(parts.select("part", "part_start"), "part").join(blocks.select("block", "start"), "block")
    offsets = offsets.select("part", "seq", (F.col("start") + F.col("part_start") + F.col("seq_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload", 1):
            shard = Shard(batch.column("payload")[0].as_py())
            ids = shard.read().astype("<u4")
            ends = np.cumsum(shard.lengths.astype(np.int64))
            begins = ends - shard.lengths
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
            k = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(batch.column("part")[0], k), pa.repeat(batch.column("seq")[0], k), batch.column("doc_ids")[0].values, pa.array(begins, pa.int64()), pa.array(shard.lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
            )

    read = shards.select("part", "seq", "doc_ids", "payload").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(offsets, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return read_shards(write_shards(docs, path))

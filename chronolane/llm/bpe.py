"""Byte-level BPE by forced boundaries.

A pair of bytes that is inside no vocabulary token can never be inside a token of an encoding, so
a text may be cut between them. The fragments are encoded independently, each distinct one once
per worker, and their ids are concatenated. A cut is used only where the pre-tokenizer cannot look
across it: the left character is no white space, the right one no apostrophe, and it lies between
characters.

Null texts count as empty and have no ids; repeated rows are encoded each, long texts whole; an empty table
gives an empty one, and columns that are not asked for are ignored. The ids equal those of the tokenizers library with
add_special_tokens=False, including special tokens spelled out in a text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .shared import give_back, slices

#: Bytes of encoded fragments that a worker keeps, and what one takes besides its own bytes and ids.
KEPT_BYTES, ENTRY_BYTES = 40 << 20, 170
#: White space outside ASCII begins with these bytes in UTF-8 (fixed values of the Unicode standard).
WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with one byte-level tokenizer file; keeps a bounded store of encoded fragments.

    A tokenizer of another kind (a normalizer, another pre-tokenizer or model, tokens that reach over
    white space) raises ValueError: its texts could not be cut by byte pairs.
    """

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer, models, pre_tokenizers

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        added = t.get_added_tokens_decoder()
        plain = isinstance(t.model, models.BPE) and not any((t.model.dropout, t.model.unk_token, t.model.continuing_subword_prefix, t.model.end_of_word_suffix, t.model.byte_fallback))
        splits = isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) and t.pre_tokenizer.use_regex and not t.pre_tokenizer.add_prefix_space
        if not plain or not splits or t.normalizer is not None or any(x.lstrip or x.rstrip or x.single_word for x in added.values()):
            raise ValueError(f"no plain byte-level BPE: {path}")
        inside, lengths = np.zeros((256, 256), bool), np.zeros(1 + max([*added, *t.get_vocab().values()]), np.int32)
        for i, token in self._spelled():
            lengths[i] = len(token)
            for a, b in zip(token, token[1:]):
                inside[a, b] = True
        self.lengths, self.dtype = lengths, np.dtype("<u2" if len(lengths) <= 1 << 16 else "<u4")
        cut = ~inside
        cut[[*range(9, 14), *range(28, 33)], :] = False
        cut[:, ord("'")] = False
        cut[:, 0x80:0xC0] = False
        narrow = cut.copy()
        narrow[0x80:, :] = False
        self.cuts, self.narrow_cuts = cut.ravel(), narrow.ravel()
        # the store has two halves: what is not asked for while one fills is dropped with it
        self.half = kept_bytes // 2
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.known_bytes = 0

    def _spelled(self) -> Iterator[tuple[int, bytes]]:
        """Each id with the bytes that it stands for."""
        letters, added = byte_alphabet(), self.tokenizer.get_added_tokens_decoder()
        for token, i in self.tokenizer.get_vocab().items():
            if i not in added and all(c in letters for c in token):
                yield i, bytes(letters[c] for c in token)
        for i, token in added.items():
            yield i, token.content.encode()

    @cached_property
    def bytes_of(self) -> list[bytes]:
        out = [b""] * len(self.lengths)
        for i, token in self._spelled():
            out[i] = token
        return out

    @cached_property
    def decimal(self) -> list[str]:
        return [str(i) for i in range(len(self.lengths))]

    def cut(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All texts in one, the borders of their fragments, and each text's first fragment (one more entry at the end)."""
        buf = b"".join(texts)
        ends = np.cumsum([0, *map(len, texts)])
        if not buf:
            return buf, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(buf, np.uint8)
        table = self.narrow_cuts if any(x in buf for x in WIDE_SPACE) else self.cuts
        flags = np.zeros(len(buf) + 1, bool)
        flags[1:-1] = table[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        flags[ends] = True
        at = np.flatnonzero(flags)
        return buf, at, np.searchsorted(at, ends)

    def learn(self, fragments: set[bytes]) -> None:
        """Encodes fragments. Between an ASCII letter or digit and a space is a certain cut, so those that begin and end so are encoded as one text."""
        spaced, rest = [], []
        for x in fragments:
            (spaced if x[0] == 32 and x[-1:].isalnum() and x[1] != 32 else rest).append(x)
        for i in range(0, len(spaced), 1000):
            part = spaced[i : i + 1000]
            ids = np.array(self.tokenizer.encode(b"".join(part).decode(), add_special_tokens=False).ids, np.int64)
            stops = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(x) for x in part])) + 1
            raw, width, start = ids.astype(self.dtype).tobytes(), self.dtype.itemsize, 0
            for x, stop in zip(part, stops.tolist()):
                self.known[x] = raw[start * width : stop * width]
                start = stop
        for x, e in zip(rest, self.tokenizer.encode_batch([x.decode() for x in rest], add_special_tokens=False)):
            self.known[x] = np.array(e.ids, self.dtype).tobytes()
        self.known_bytes += sum(len(x) + len(self.known[x]) + ENTRY_BYTES for x in fragments)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Equal fragments are found by 64-bit hashes over all texts, and looked up once."""
        buf, at, first = self.cut([x.encode() for x in texts])
        if not buf:
            return [np.zeros(0, self.dtype) for _ in texts]
        if self.known_bytes > self.half:
            self.before, self.known, self.known_bytes = self.known, {}, 0
        h = textvec.piece_hashes(np.frombuffer(buf, np.uint8), at)
        by = np.argsort(h)
        h = h[by]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        entry = np.empty(len(by), np.int64)
        entry[by] = np.cumsum(new) - 1
        some = by[new]
        fragments = [buf[i:j] for i, j in zip(at[some].tolist(), at[some + 1].tolist())]
        found = list(map(self.known.get, fragments))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            sought = {fragments[i] for i in missing}
            again = {x: ids for x in sought if (ids := self.before.get(x)) is not None}
            self.known |= again
            self.known_bytes += sum(len(x) + len(ids) + ENTRY_BYTES for x, ids in again.items())
            self.learn(sought - again.keys())
            for i in missing:
                found[i] = self.known[fragments[i]]
        # each fragment's ids, one after the other
        flat = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.array([len(x) for x in found]) // self.dtype.itemsize
        begins = (np.cumsum(sizes) - sizes)[entry]
        sizes = sizes[entry]
        stops = np.concatenate(([0], np.cumsum(sizes)))
        ids = flat[np.repeat(begins - stops[:-1], sizes) + np.arange(stops[-1])]
        bounds = stops[first].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def release(self) -> None:
        """Drops the store of fragments."""
        self.known, self.before, self.known_bytes = {}, {}, 0

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, kept_bytes: int = KEPT_BYTES) -> Codec:
    """A worker's codec. It stays between tasks: reading the vocabulary again costs more than it holds."""
    return Codec(path, kept_bytes)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and ids (array<int>) of each row's whole text."""
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = codec(path).encode([x or "" for x in batch.column("text").to_pylist()])
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*keep, "ids"])
        codec(path).release()  # other stages of a pipeline run in the same worker
        give_back()

    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column decoded: the text of its ids. Null ids count as none."""
    names = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*names).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            back = [codec(path).decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(back, pa.string())], [*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encode, then decode from those ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            ids = c.encode([x or "" for x in batch.column("text").to_pylist()])
            decimal = [hashlib.sha256(",".join(map(c.decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(decimal), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)

"""Words and word shingles of whole texts as 64-bit hashes, computed with numpy over a batch at a time.

Words are the runs `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. Null texts have no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
#: Bytes that belong to a run of letters: ASCII letters, and all bytes of characters beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_VALUE[_SPACE] = 0
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_pow = {"mul": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_pow[kind]) < n:
        size = 1 << (n - 1).bit_length()
        _pow[kind] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)))
    return _pow[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # of each word, in bytes
    ends: np.ndarray
    first: np.ndarray  # of each document: its first word; one more entry at the end
    hashes: np.ndarray  # of each word

    def __len__(self) -> int:
        return len(self.first) - 1


def words(column: pa.Array, letters: bool = False) -> Words:
    """The words of each text; with letters, its runs of letters instead."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint64))
    solid = _LETTER[data] if letters else ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = solid[cuts]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    stops[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if len(starts):
        value = _VALUE[data]
        if letters:
            value[~solid] = 0
        sums = np.add.reduceat(value * _powers("mul", _MUL, n), starts)
        hashes = mix(sums * _powers("inv", _INV, n)[starts] + (ends - starts).astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)


def windows(w: Words, k: int) -> np.ndarray:
    """The hash of the k words from each position on; positions where a document's end is nearer hold rubbish."""
    h = w.hashes
    if len(h) < k:
        return np.zeros(len(h), np.uint64)
    out = np.zeros(len(h), np.uint64)
    m = len(h) - k + 1
    for i in range(k):
        out[:m] += h[i : i + m] * _STEP[i]
    return mix(out)


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Each text's set of k-word shingles, as sorted distinct hashes; with fewer words, of the whole sequence; without words, empty."""
    w = words(column)
    all_windows = windows(w, k)
    out = []
    for i in range(len(w)):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= k:
            s = np.sort(all_windows[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif b > a:
            h = w.hashes[a:b]
            out.append(mix((h * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a) * _STEP[63]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def piece_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of each piece of data between the borders `at`, letter case included; no piece is empty."""
    starts = at[:-1]
    sums = np.add.reduceat(_BYTE[data] * _powers("mul", _MUL, len(data)), starts)
    return mix(sums * _powers("inv", _INV, len(data))[starts] + np.diff(at).astype(np.uint64))


def beginnings(w: Words, k: int) -> np.ndarray:
    """The hash of each word's first k bytes; 0 for shorter words."""
    long = np.flatnonzero(w.ends - w.starts >= k)
    out = np.zeros(len(w.starts), np.uint64)
    h = np.full(len(long), np.uint64(k), np.uint64)
    for i in range(k):
        h += _VALUE[w.data[w.starts[long] + i]] * _STEP[i + 8]
    out[long] = mix(h)
    return out


def word_hash(word: str, letters: bool = False) -> int:
    return int(words(pa.array([word], pa.large_string()), letters).hashes[0])

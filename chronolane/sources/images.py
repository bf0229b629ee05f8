"""PNG pictures as luminance: 8-bit, not interlaced; grey, RGB, with or without alpha."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Channels of the PNG colour types that are read, and the weights of luminance.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WEIGHTS = np.array([0.299, 0.587, 0.114])


def samples(data: bytes) -> np.ndarray:
    """The samples by line, column and channel. Raises ValueError for what is no such PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, width = 8, [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if width is None or depth != 8 or interlace or colour not in CHANNELS:
        raise ValueError("only 8-bit PNG without interlace is read")
    n = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(raw[y, 0], raw[y, 1:], above, n)
    return out.reshape(height, width, n)


def luminance(data: bytes) -> np.ndarray:
    """Rows of luminance, 0 to 255."""
    pixels = samples(data)
    return pixels[..., 0].astype(float) if pixels.shape[2] < 3 else pixels[..., :3] @ WEIGHTS


#: The columns in which a section bar is looked for, and what a dark pixel of it is below: red, green, blue, which do not fall from one to the next.
BAR_COLUMNS, BAR_BELOW = (15, 425), (60, 100, 150)


def bar_pixels(data: bytes) -> np.ndarray:
    """For each line the share of pixels within BAR_COLUMNS that are of a section bar's colour; grey counts as equal red, green and blue."""
    pixels = samples(data)
    rgb = pixels[..., :3] if pixels.shape[2] >= 3 else np.repeat(pixels[..., :1], 3, axis=2)
    low, high = (min(c, rgb.shape[1]) for c in BAR_COLUMNS)
    r, g, b = (rgb[:, low:high, i] for i in range(3))
    hits = (r < BAR_BELOW[0]) & (g < BAR_BELOW[1]) & (b < BAR_BELOW[2]) & (b >= g) & (g >= r)
    return hits.sum(axis=1) / max(1, high - low)


def dark_lines(pixels: np.ndarray, dark: float = 96.0) -> np.ndarray:
    """The share of dark pixels of each line."""
    return (pixels < dark).mean(axis=1)


def _lines_of(spark: SparkSession, path: str, share_of: Callable[[bytes], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    share = share_of(data)
                    y = np.arange(len(share))
                except (ValueError, struct.error, zlib.error):
                    y = share = [None]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(share), pa.string()), pa.array(y, pa.int32()), pa.array(share, pa.float64())], ["path", "y", "dark"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, y int, dark double")


def read_lines_of(spark: SparkSession, path: str, dark: float = 96.0) -> DataFrame:
    """(path, y, share of dark pixels) of each line of each PNG under path; a picture that cannot be read has one row, with nulls."""
    return _lines_of(spark, path, lambda data: dark_lines(luminance(data), dark))


def read_bars_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, y, share of pixels of a section bar's colour) of each line of each PNG under path; a picture that cannot be read has one row, with nulls."""
    return _lines_of(spark, path, bar_pixels)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    if kind > 4:
        raise ValueError("unknown filter")
    line = [0] * n + row.tolist()
    up = [0] * n + above.tolist()
    for i in range(n, len(line)):
        a, b, c = line[i - n], up[i], up[i - n]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        line[i] = (line[i] + guess) & 255
    return np.array(line[n:], np.uint8)


def read_pictures(spark: SparkSession, path: str, dark: float = 96.0) -> DataFrame:
    """path, width, height, mean luminance and share of dark pixels of each PNG under path; pictures that cannot be read have nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("content").to_pylist():
                try:
                    y = luminance(data)
                    rows.append((y.shape[1], y.shape[0], float(y.mean()), float((y < dark).mean())))
                except (ValueError, struct.error, zlib.error):
                    rows.append((None,) * 4)
            w, h, m, d = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(m, pa.float64()), pa.array(d, pa.float64())], ["path", "width", "height", "mean", "dark"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, width int, height int, mean double, dark double")

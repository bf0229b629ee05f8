"""Payload bytes as baseline JPEG, and DC-only luminance thumbnails from baseline JPEG.

Writing: each byte is the mean of one 8x8 luminance block (DC step 8, no AC coefficients), so the
1/8-scale thumbnail of the picture is the payload itself and nothing is lost. A restart marker ends
every 96 blocks. A comment segment holds the payload's length.

Reading: markers are parsed, the scan is cut at restart markers and freed of stuffing, and all
intervals of a batch are Huffman-decoded in step with numpy: one lookup gives the DC difference and
the length up to the end of its block. Pictures with other blocks, colour or AC coefficients are
decoded one symbol at a time; only their luminance DC values are kept.

Null texts count as empty: the payload is then 576 bytes of 255. Repeated rows are stored each, equal
texts to equal bytes; further columns are ignored; an empty table gives an empty one. Payloads that one picture's sides
cannot hold are stored as several pictures, one after the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

UNIT, FILL, INTERVAL = 576, 255, 96
NARROW, WIDE, MOST_ROWS = 24, 8184, 8188
PICTURE_BYTES = WIDE * MOST_ROWS // UNIT * UNIT
#: Code lengths of the DC categories 0 to 8 that the writer uses; the AC table has the end of block alone.
DC_LENGTHS = {2: 3, 3: 3, 4: 3, 5: 3, 7: 3, 0: 4, 1: 4, 6: 4, 8: 4}
_ZIGZAG_QUANT = bytes([8] + [1] * 63)


def huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a DHT segment."""
    table, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _dht(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)), bytes(order)


_DC, _AC = _dht(DC_LENGTHS), _dht({0: 1})


@lru_cache(maxsize=1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255, with the end of block."""
    codes = {s: (code, n) for (n, code), s in huffman(*_DC).items()}
    value, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = codes[cat]
        value[d + 255] = ((code << cat) | (d if d >= 0 else d + (1 << cat) - 1)) << 1
        length[d + 255] = n + cat + 1
    return value, length


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def _header(columns: int, rows: int, used: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xFE, b"payload=%d" % used)
        + _segment(0xDB, b"\x00" + _ZIGZAG_QUANT)
        + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + _DC[0] + _DC[1])
        + _segment(0xC4, b"\x10" + _AC[0] + _AC[1])
        + _segment(0xDD, struct.pack(">H", INTERVAL))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def layout(size: int) -> tuple[int, int]:
    """Columns and rows of blocks for a payload."""
    if size <= NARROW * MOST_ROWS:
        return NARROW, -(-size // NARROW)
    rows = -(-size // WIDE)
    return WIDE, rows + -rows % 4


def write_many(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload, whose lengths are positive multiples of 576."""
    pictures, owner = [], []
    for i, p in enumerate(payloads):
        for at in range(0, len(p), PICTURE_BYTES):
            part = p[at : at + PICTURE_BYTES]
            columns, rows = layout(len(part))
            pictures.append((columns, rows, len(part), part + bytes([FILL]) * (columns * rows - len(part))))
            owner.append(i)
    samples = np.frombuffer(b"".join(x[3] for x in pictures), np.uint8).astype(np.int16) - 128
    samples = samples.reshape(-1, INTERVAL)
    diffs = samples.copy()
    diffs[:, 1:] -= samples[:, :-1]
    value, length = _codes()
    index = diffs + 255
    n = length[index]
    ends = np.cumsum(n, axis=1)
    bits = ends[:, -1]
    size = (bits + 7) >> 3
    starts = np.cumsum(size) - size
    at = (starts[:, None] * 8 + ends - n).ravel()
    placed = value[index].ravel() << (24 - (at & 7) - n.ravel()).astype(np.uint32)
    total = int(size.sum())
    byte = at >> 3
    raw = np.bincount(byte, placed >> 16, total + 2) + np.bincount(byte + 1, (placed >> 8) & 255, total + 2)[: total + 2] + np.bincount(byte + 2, placed & 255, total + 2)[: total + 2]
    raw = raw[:total].astype(np.uint8)
    raw[starts + size - 1] |= ((1 << (size * 8 - bits)) - 1).astype(np.uint8)
    # stuffing, and a marker after each interval
    full = raw == 255
    shift = np.cumsum(full) - full + 2 * np.repeat(np.arange(len(size)), size)
    out = np.zeros(total + int(full.sum()) + 2 * len(size), np.uint8)
    out[np.arange(total) + shift] = raw
    last = starts + size - 1
    mark = last + shift[last] + full[last] + 1
    counts = np.array([c * r // INTERVAL for c, r, _, _ in pictures])
    firsts = np.cumsum(counts) - counts
    order = np.arange(len(size)) - np.repeat(firsts, counts)
    out[mark] = 255
    out[mark + 1] = 0xD0 + (order & 7)
    out[mark[firsts + counts - 1] + 1] = 0xD9
    scan, stop = out.tobytes(), (mark[firsts + counts - 1] + 2).tolist()
    media: list[list[bytes]] = [[] for _ in payloads]
    begin = 0
    for i, (columns, rows, used, _), end in zip(owner, pictures, stop):
        media[i] += [_header(columns, rows, used), scan[begin:end]]
        begin = end
    return [b"".join(x) for x in media]


class Picture:
    """The markers of one baseline JPEG that begins at `at` of data."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.tables, self.quant, self.interval, self.comment = {}, {}, 0, b""
        at += 2
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC0:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xC4:
                raise ValueError("only baseline JPEG is read")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                self.scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                self.begin = at
                return

    @property
    def luminance(self) -> tuple[int, int, int, int]:
        return self.components[0]

    def blocks(self) -> tuple[int, int]:
        return -(-self.width // 8), -(-self.height // 8)


@lru_cache(maxsize=16)
def _fused(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> np.ndarray:
    """For each 16 bits: DC difference * 32 + length up to and with an end of block, or 0 where they hold no whole block."""
    out = np.zeros(1 << 16, np.int32)
    ends = [(n, code) for (n, code), s in huffman(*ac).items() if s == 0]
    if not ends:
        return out
    m, end = ends[0]
    for (n, code), cat in huffman(*dc).items():
        total = n + cat + m
        if total > 16 or cat > 11:
            continue
        bits = np.arange(1 << cat)
        diff = np.where(bits >= (1 << cat) >> 1, bits, bits - (1 << cat) + 1) if cat else np.zeros(1, np.int64)
        first = ((((code << cat) | bits) << m) | end) << (16 - total)
        spread = np.arange(1 << (16 - total))
        out[(first[:, None] + spread).ravel()] = np.repeat(diff * 32 + total, len(spread))
    return out


def _slow(p: Picture, data: bytes) -> np.ndarray:
    """Luminance DC values by one symbol at a time; any baseline scan with all components interleaved."""
    tables = {k: huffman(*v) for k, v in p.tables.items()}
    state = {"at": p.begin, "buf": 0, "n": 0}

    def bit() -> int:
        if not state["n"]:
            byte = data[state["at"]]
            state["at"] += 1
            if byte == 255:
                if data[state["at"]]:
                    state["at"] -= 1
                    byte = 255  # what follows a marker reads as ones
                else:
                    state["at"] += 1
            state["buf"], state["n"] = byte, 8
        state["n"] -= 1
        return state["buf"] >> state["n"] & 1

    def take(k: int) -> int:
        v = 0
        for _ in range(k):
            v = v << 1 | bit()
        return v

    def symbol(table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | bit()
            if (n, code) in table:
                return table[n, code]
        raise ValueError("bad Huffman code")

    top_h, top_v = max(c[1] for c in p.components), max(c[2] for c in p.components)
    single = len(p.components) == 1
    columns, rows = p.blocks()
    across, down = (columns, rows) if single else (-(-p.width // (8 * top_h)), -(-p.height // (8 * top_v)))
    lh, lv = (1, 1) if single else p.luminance[1:3]
    grid = np.zeros((down * lv, across * lh), np.int32)
    pred = dict.fromkeys((c[0] for c in p.components), 0)
    for k in range(across * down):
        if p.interval and k and k % p.interval == 0:
            state["n"] = 0
            while not (data[state["at"]] == 255 and 0xD0 <= data[state["at"] + 1] <= 0xD7):
                state["at"] += 1
            state["at"] += 2
            pred = dict.fromkeys(pred, 0)
        for name, h, v, _ in p.components:
            dc, ac = tables[p.scan[name] >> 4], tables[16 + (p.scan[name] & 15)]
            for b in range(1 if single else h * v):
                cat = symbol(dc)
                bits = take(cat)
                pred[name] += bits if not cat or bits >> (cat - 1) else bits - (1 << cat) + 1
                at = 1
                while at < 64:
                    rs = symbol(ac)
                    if rs == 0:
                        break
                    take(rs & 15)
                    at += (rs >> 4) + 1
                if name == p.luminance[0]:
                    grid[k // across * lv + b // lh, k % across * lh + b % lh] = pred[name]
    return grid[:rows, :columns]


def thumbnails(media: list[bytes]) -> list[list[tuple[Picture, np.ndarray]]]:
    """For each stored form its pictures, each with the 8-bit luminance thumbnail (rows, columns)."""
    jobs = []
    for i, data in enumerate(media):
        at = 0
        while at < len(data):
            p = Picture(data, at)
            end = data.find(b"\xff\xd9", p.begin)
            if end < 0:
                raise ValueError("JPEG without end")
            jobs.append((i, p, data, end))
            at = end + 2
    out: list[list] = [[] for _ in media]
    fast: dict[tuple, list] = {}
    grids: dict[int, np.ndarray] = {}
    for j, (_, p, _, _) in enumerate(jobs):
        columns, rows = p.blocks()
        if len(p.components) == 1 and p.interval and columns * rows % p.interval == 0:
            fast.setdefault((p.tables[p.scan[p.luminance[0]] >> 4], p.tables[16 + (p.scan[p.luminance[0]] & 15)], p.interval), []).append(j)
    for (dc, ac, interval), members in fast.items():
        values, good = _in_step(b"".join(jobs[j][2][jobs[j][1].begin : jobs[j][3] + 2] for j in members), _fused(dc, ac), interval)
        at = 0
        for j in members:
            columns, rows = jobs[j][1].blocks()
            k = columns * rows // interval
            if good[at : at + k].all():
                grids[j] = values[at : at + k].reshape(rows, columns)
            at += k
    for j, (i, p, data, _) in enumerate(jobs):
        grid = grids[j] if j in grids else _slow(p, data)
        step = p.quant[p.luminance[3]]
        pixels = np.clip((grid * step + 1024 + 4) >> 3, 0, 255).astype(np.uint8)
        out[i].append((p, pixels))
    return out


def _in_step(scans: bytes, table: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """DC values (interval by interval) of scans put together, and which intervals this way could decode."""
    raw = np.frombuffer(scans, np.uint8)
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    keep = np.ones(len(raw), bool)
    keep[full[after == 0] + 1] = False
    marks = full[after != 0]
    keep[marks] = False
    keep[marks + 1] = False
    data = raw.compress(keep)
    stop = marks - (np.cumsum(~keep)[marks] - 1)  # each interval's end in data
    begin = np.concatenate(([0], stop[:-1]))
    wide = np.concatenate((data, np.full(4, 255, np.uint8))).astype(np.uint32)
    window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    at = begin * 8
    values = np.empty((len(begin), interval), np.int16)
    pred = np.zeros(len(begin), np.int32)
    good = np.ones(len(begin), bool)
    for k in range(interval):
        entry = table[((window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16))]
        length = entry & 31
        if not length.all():
            good &= length > 0
        at += length
        np.minimum(at, len(data) * 8, out=at)
        pred += entry >> 5
        values[:, k] = pred
    return values, good & (at <= stop * 8)


def cell_means(pixels: np.ndarray) -> np.ndarray:
    """The means of 8 x 9 cells of a thumbnail."""
    rows, columns = pixels.shape
    r, c = np.arange(8) * rows // 8, np.arange(9) * columns // 9
    if rows < 8 or columns < 9:
        return pixels[np.minimum(r, rows - 1)][:, np.minimum(c, columns - 1)].astype(np.float64)
    sums = np.add.reduceat(np.add.reduceat(pixels, r, axis=0, dtype=np.int64), c, axis=1)
    return sums / (np.diff(np.append(r, rows))[:, None] * np.diff(np.append(c, columns)))


def look(thumbnails: list[np.ndarray]) -> str:
    """A 64-bit difference hash of a text's thumbnails: for each of 8 x 9 cells' means over all of them, whether it exceeds its left neighbour."""
    cells = np.average([cell_means(x) for x in thumbnails], axis=0, weights=[x.size for x in thumbnails]) if len(thumbnails) > 1 else cell_means(thumbnails[0])
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes([FILL]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the column media: each whole text's payload as baseline JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [payload_of(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array(write_many([p for p, _ in made]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, docs.select("doc_id").schema.add("n_bytes", "long").add("media", "binary"))


def features(stored: DataFrame) -> DataFrame:
    """What the stored pictures hold: payload digests, sizes, and the feature WIDTHxHEIGHT:thumbnail hash over all pictures of a text (greatest width, heights summed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            media = batch.column("media").to_pylist()
            rows = []
            for data, pictures in zip(media, thumbnails(media)):
                payload = b"".join(pixels.tobytes()[: int(p.comment.partition(b"=")[2])] for p, pixels in pictures)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{max(p.width for p, _ in pictures)}x{sum(p.height for p, _ in pictures)}:{look([x for _, x in pictures])}"))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = stored.select("doc_id", "n_bytes").schema
    for name, kind in zip(names[2:], ("long", "string", "long", "long", "string", "string")):
        schema = schema.add(name, kind)
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)

"""Operators on whole texts against plain versions, on a table with every awkward case."""

import functools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolane.llm import backoff_lm, bpe, compression, jpeg, pii, textvec, toxicity, wavelet
from chronolane.llm.registry import vocabulary

LONG = "longer words here, " * 9000
ROWS = [
    (1, "The quick  brown\nfox's jump", "en", "a", 27),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, "The quick  brown\nfox's jump", "en", "a", 27),
    (5, "<|endoftext|> é ß 中文　x\xa0y \x1c '' 's", "fr", "b", 20),
    (6, LONG, "de", "c", len(LONG)),
    (7, "mail a.b@c.de or 10.0.0.1, +1 (555) 555-1234, 4111 1111 1111 1111", "en", "a", 60),
    (7, "mail a.b@c.de or 10.0.0.1, +1 (555) 555-1234, 4111 1111 1111 1111", "en", "a", 60),
    (8, "   \t\n ", "en", "a", 6),
    (None, "no id of its own", "en", "a", 16),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, ids string, part string"


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, 0.5, "x", "y", "z") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0, 1) for i in range(1, 9)] + [(1, 1, 0, 9), (3, None, None, 0)], "doc_id long, quality int, toxic int, score int")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_bpe_equals_library(docs, empty, library):
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, vocabulary()).collect()), key=str)
    want = []
    for i, t, *_ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(empty, vocabulary()).count() == 0


def test_bpe_columns_round_trip(docs):
    encoded = bpe.encode(docs, vocabulary(), ("doc_id", "lang"))
    assert encoded.columns == ["doc_id", "lang", "ids"]
    back = sorted(((r["doc_id"], r["decoded"]) for r in bpe.decode(encoded, vocabulary()).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t, *_ in ROWS), key=str)


def test_bpe_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        bpe.Codec(vocabulary("word_bpe_49k.json"))


def test_bpe_small_store_changes_nothing(library):
    codec = bpe.Codec(vocabulary(), kept_bytes=4000)
    for i in range(40):
        text = " ".join(f"word{i * 7 + j % 11} é{j}!" for j in range(30))
        assert list(codec.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids
        assert len(codec.known) + len(codec.before) < 200


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from([" ", "  ", "\n", "'s", "'", "?'s", "<|endoftext|>", "<|", "q", "x"])), max_size=12))
def test_forced_boundaries_any_text(parts):
    text = "".join(parts)
    codec = bpe.codec(vocabulary())
    ids = codec.encode([text])[0]
    assert list(ids) == codec.tokenizer.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == text


def test_wavelet_files(spark, docs, empty, library):
    got = [tuple(r) for r in wavelet.store(spark, docs, vocabulary()).orderBy("start").collect()]
    want, start = [], 0
    for i, t, *_ in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert wavelet.store(spark, empty, vocabulary()).count() == 0


def test_wavelet_access_rank_select():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (700, 3), (5000, 50000), (4096, 70000)):
        ids = rng.integers(0, top, n)
        shard = wavelet.Shard(wavelet.build(ids, np.array([n])))
        assert (shard.read() == ids).all()
        for token in [0, *ids[:5].tolist(), 99999]:
            where = np.flatnonzero(ids == token)
            assert shard.rank(token) == len(where)
            assert [shard.select(token, k) for k in range(min(3, len(where)))] == where[:3].tolist()
            assert shard.select(token, len(where)) == -1
        for i in range(0, n, 601):
            assert shard.access(i) == ids[i]
            assert shard.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
    with pytest.raises(ValueError):
        wavelet.Shard(wavelet.build(ids, np.array([n]))[:-1] + b"?")


def test_jpeg_round_trip(docs, empty):
    rows = {r["doc_id"]: r for r in jpeg.features(jpeg.store(docs)).collect()}
    for i, t, *_ in ROWS:
        payload, n = jpeg.payload_of(t)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert len(payload) % 576 == 0 and r["media_bytes"] > 0
    assert rows[1]["media_sha256"] == rows[4]["media_sha256"] and rows[1]["feature"] == rows[4]["feature"]
    assert jpeg.features(jpeg.store(empty)).count() == 0


def test_jpeg_slow_path_agrees_and_reads_ac_and_colour():
    media = jpeg.write_many([bytes(range(256)) * 9, b"\xff" * 576])
    for data, payload in zip(media, (bytes(range(256)) * 9, b"\xff" * 576)):
        p = jpeg.Picture(data)
        assert (jpeg._slow(p, data) + 128).astype(np.uint8).tobytes() == payload
    # a picture of two components with one AC coefficient in each block
    dc, ac = jpeg._dht({0: 2, 4: 2, 5: 2}), jpeg._dht({0: 1, 0x11: 2})
    code = {("dc", s): f"{c:0{n}b}" for (n, c), s in jpeg.huffman(*dc).items()} | {("ac", s): f"{c:0{n}b}" for (n, c), s in jpeg.huffman(*ac).items()}
    bits = code["dc", 4] + "1010" + code["ac", 0x11] + "1" + code["ac", 0] + code["dc", 0] + code["ac", 0]
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    data = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, b"\x08\0\x08\0\x08\x02\x01\x11\0\x02\x11\0") + seg(0xC4, b"\0" + dc[0] + dc[1]) + seg(0xC4, b"\x10" + ac[0] + ac[1]) + seg(0xDA, b"\x02\x01\0\x02\0\0\x3f\0") + scan + b"\xff\xd9"
    (picture, pixels), = jpeg.thumbnails([data])[0]
    assert (picture.width, picture.height) == (8, 8) and pixels.tolist() == [[138]]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def valid(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
            return 13 <= len(d) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "256", "4111111111111111", "+", "+1", "@", "a@b", ".c", ".", " ", "-", "(", ")", "ü", "_", "..", "555", "١", "iban ", "street"]), max_size=24))
def test_pii_base_spans(parts):
    text = "".join(parts)
    assert [s for s in pii.find(text) if s[0] in pii.BASE] == base_spans(text)


def plain_added(text):
    """The added kinds by regular expressions, each kind for itself."""
    cue = lambda words: "(?:" + "|".join(re.escape(f) for w in words for f in (w, w.capitalize(), w.upper())) + ")"
    out, free = [], 0
    for m in re.finditer(f"(?={cue(pii.SCHEMES)})", text):
        scheme = re.compile(cue(pii.SCHEMES)).match(text, m.start())
        if m.start() >= free and (rest := re.compile(r"[^ \t\n\v\f\r\"'<>|]+").match(text, scheme.end())):
            out.append(("url", m.start(), rest.end()))
            free = rest.end()
    free = 0
    for m in sorted((m for w in pii.ACCOUNT_CUES for m in re.finditer(f"(?={cue([w])})", text)), key=lambda m: m.start()):
        for end in sorted({m.start() + len(w) for w in pii.ACCOUNT_CUES if text[m.start() : m.start() + len(w)] in (w, w.capitalize(), w.upper())}):
            got = re.compile(r"[ :=#\"']{1,6}([A-Za-z0-9_-]+)").match(text, end)
            if m.start() >= free and got and len(got[1]) >= 6 and sum(c in "0123456789" for c in got[1]) >= 4:
                out.append(("account", got.start(1), got.end(1)))
                free = got.end(1)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["http://", "mailto:", "HTTPS://", "x", "9", "12345", " ", ":", "'", "account", "Iban", "SSN", "-", "_", "é", "a1b2c3d4", "street"]), max_size=24))
def test_pii_added_spans(parts):
    text = "".join(parts)
    assert [s for s in pii.find(text) if s[0] in ("url", "account")] == plain_added(text)


def test_pii_addresses():
    found = lambda x: [x[a:b] for k, a, b in pii.find(x) if k == "address"]
    assert found("at 12 Main Street now") == ["12 Main Street"]
    assert found("rue de 5, then") == ["rue de 5"] and found("calle 77") == ["calle 77"]
    assert found("street of no number") == [] and found("123456 street") == []
    assert found("12 " + "x" * 40 + " street") == ["12 " + "x" * 40 + " street"] and found("12 " + "x" * 41 + " street") == []


@pytest.mark.parametrize("unit", ["street", "street ", "account", "account ", "a@", "+1 ", "1.1.", "http://", "@a.b-"])
def test_pii_time_is_linear(unit):
    import time

    start = time.process_time()
    pii.find(unit * 100_000)
    assert time.process_time() - start < 20


def test_pii_rows_and_masks(docs, empty):
    for r in pii.spans(docs).collect():
        text = next(t for i, t, *_ in ROWS if i == r["doc_id"]) or ""
        spans = base_spans(text)
        assert r["base_sha256"] == hashlib.sha256(pii.spelled(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[7] == "mail [email] or [ip], [phone], [card]" and texts[2] is None and texts[3] == ""
    assert pii.spans(empty).count() == 0 and pii.redact(empty).count() == 0
    assert pii.masked("pay to account: DE12-3456-7890 at 12 Main Street, see https://x.y/z", pii.find("pay to account: DE12-3456-7890 at 12 Main Street, see https://x.y/z")) == "pay to account: [account] at [address], see [url]"


def test_words_and_shingles():
    def plain(x):
        ws = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), x))
        return len({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}) if len(ws) >= 5 else int(bool(ws))

    texts = ["", "a", "A b C d e f a b c d e f", " x\ty ", "é " * 30, None, "z" * 70000 + " q", "one two three four"]
    column = pa.array(texts, pa.string())
    assert [len(s) for s in textvec.shingle_sets(column)] == [plain(x or "") for x in texts]
    assert [len(s) for s in textvec.shingle_sets(column.slice(2, 3))] == [plain(x or "") for x in texts[2:5]]
    assert textvec.word_hash("Idiot") == textvec.word_hash("idiot") != textvec.word_hash("idiots")


def test_scores_are_defined_for_every_row(docs, empty, labels):
    for score in (toxicity.score, compression.score):
        rows = score(docs, labels).collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
        for r in rows:
            assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert score(empty, labels).count() == 0
        assert score(docs, labels.limit(0)).count() == len(ROWS)
    assert toxicity.reject(docs, labels).columns == docs.columns


def test_label_model_recovers_rates():
    rng = np.random.default_rng(2)
    y = rng.random(20000) < 0.1
    rates = np.vstack([np.full(16, 0.01), np.linspace(0.2, 0.7, 16)])
    v = rng.random((20000, 16)) < rates[y.astype(int)]
    patterns, counts = np.unique(v @ (1 << np.arange(16)), return_counts=True)
    start = np.vstack([np.full(16, 0.02), np.full(16, 0.4)])
    found, _, share = toxicity.label_model(patterns, counts, 0.2, start)
    assert abs(share - 0.1) < 0.01 and np.abs(found - rates).max() < 0.05


def test_classifiers_on_held_out_rows(spark):
    from chronolane.llm.shared import documents, table

    sf = "/root/testdata/sf0.1"
    known = {r["doc_id"]: r for r in table(spark, sf, "labels").collect()}
    for score, label, least in ((toxicity.score, "toxic", 0.97), (compression.score, "quality", 0.93)):
        rows = [r for r in score(documents(spark, sf), table(spark, sf, "labels")).collect() if r["held_out"] and r["doc_id"] in known]
        assert len(rows) > 300
        assert sum(r["predicted"] == known[r["doc_id"]][label] for r in rows) / len(rows) > least


def test_language_model(spark, docs, empty):
    rows = {r["doc_id"]: r for r in backoff_lm.score(docs).collect()}
    texts = [(i, [*re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), None]) for i, t, *_ in ROWS]
    counts: dict = {}
    for i, ws in texts:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, ws in texts:
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert r["score"] < 0
    assert backoff_lm.score(empty).count() == 0


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_language_model_keeps_every_ngram(spark, monkeypatch, size):
    """Against brute force, with n-grams seen once, repeated rows and hot n-grams; the sizes of units, buckets and lanes change nothing."""
    monkeypatch.setattr(backoff_lm, "LANE", 16)
    monkeypatch.setattr(backoff_lm, "UNIT_TOKENS", size)
    monkeypatch.setattr(backoff_lm, "BUCKET_KEYS", size)
    monkeypatch.setattr(backoff_lm, "RANKED", size)
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{x}" for x in np.concatenate((rng.integers(0, 9, 8), rng.integers(0, 6000, 60), rng.integers(0, 9, 30))))) for i in range(200)] + [(200, ""), (201, "w1"), (202, "never w1 seen"), (None, "w1 w2 w3 w4")]
    texts += [(300, "w1 w2 w3 w4 w1 w2")] * 200
    split = [(i, [*t.split(), None]) for i, t in texts]
    grams: list[dict] = [{}, {}, {}]
    for i, ws in split:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            for o, found in enumerate(grams):
                for j in range(len(ws) - o):
                    k = tuple(ws[j : j + o + 1])
                    found[k] = found.get(k, 0) + 1
    n, v = sum(grams[0].values()), len(grams[0])
    assert v > 4096

    @functools.cache
    def share(k):
        if len(k) == 1:
            return (grams[0].get(k, 0) + 0.1) / (n + 0.1 * (v + 1))
        mass = backoff_lm.MASS[len(k) - 2]
        return (grams[len(k) - 1].get(k, 0) + mass * share(k[1:])) / (grams[len(k) - 2].get(k[:-1], 0) + mass)

    want = sorted((str(i), round(float(sum(np.log10(share(tuple(ws[max(0, j - 2) : j + 1]))) for j in range(len(ws)))), 7)) for i, ws in split)
    rows = backoff_lm.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 7)) for r in rows) == want
    assert {r["held_out"] for r in rows} == {True, False} and not any(r["held_out"] for r in rows if r["doc_id"] is None)


def test_packed_integers():
    for x in ([], [0], [5, 2**64 - 1, 0, 7]):
        assert backoff_lm.unpack(backoff_lm.pack(np.array(x, np.uint64))).tolist() == x


def test_automaton_scores_as_the_job_does(spark):
    """The automaton in one memory, traversed from left to right, against the scores of the distributed job."""
    rng = np.random.default_rng(8)
    texts = [(i, [int(x) for x in rng.integers(1, 30, 40)]) for i in range(1, 80)]
    learns = [ws for i, ws in texts if zlib.crc32(str(i).encode()) % 10]
    spell = lambda ws: " ".join(f"w{x}" for x in ws)
    rows = {r["doc_id"]: r["score"] for r in backoff_lm.score(spark.createDataFrame([(i, spell(ws)) for i, ws in texts], "doc_id long, text string")).collect()}
    coded = [np.array([*ws, 30]) for ws in learns]  # 30 is the end
    counts = np.bincount(np.concatenate(coded), minlength=31)[1:]
    unit = counts.sum() + 0.1 * (len(counts) + 1)
    root = (counts + 0.1) / unit
    two = np.unique(np.concatenate([x[:-1] * 31 + x[1:] for x in coded]), return_counts=True)
    three = np.unique(np.concatenate([(x[:-2] * 31 + x[1:-1]) * 31 + x[2:] for x in coded]), return_counts=True)
    machine = backoff_lm.build(np.arange(30, dtype=np.uint64), counts, root, two, (np.searchsorted(two[0], three[0] // 31), three[0] % 31, three[1], np.searchsorted(two[0], three[0] % 31**2)))
    for i, ws in texts:
        ids = np.array([*ws, 30])
        for lane in (2, 7, 512):  # a text may be walked by several lanes
            assert machine.traverse(ids, np.log10(root[ids - 1]), np.array([0, len(ids)]), lane)[0] == pytest.approx(rows[i], rel=1e-9)


def test_automaton_is_a_distribution():
    """From every state, all words and the unseen one together have probability 1, by the traversal itself."""
    rng = np.random.default_rng(3)
    text = rng.integers(1, 7, 4000)
    words = np.arange(10, 16, dtype=np.uint64)
    counts = np.bincount(text, minlength=7)[1:]
    total = len(text)
    unit = total + 0.1 * 7
    root = (counts + 0.1) / unit
    base = 7
    ring = np.concatenate((text, text[:2]))  # every word is followed by one, as an end makes it in texts
    two = np.unique(ring[:-2] * base + ring[1:-1], return_counts=True)
    three = np.unique((ring[:-2] * base + ring[1:-1]) * base + ring[2:], return_counts=True)
    machine = backoff_lm.build(words, counts, root, two, (np.searchsorted(two[0], three[0] // base), three[0] % base, three[1], np.searchsorted(two[0], three[0] % base**2)))
    ends = np.log10(np.concatenate(([0.1 / unit], root)))
    for u in range(1, 7):
        for w in range(1, 7):
            sums = []
            for z in range(7):
                ids = np.array([u, w, z])
                both = machine.traverse(ids, ends[ids], np.array([0, 3])) - machine.traverse(ids[:2], ends[ids[:2]], np.array([0, 2]))
                sums.append(10 ** both[0])
            assert sum(sums) == pytest.approx(1, abs=1e-9)

"""Filter audit, ranked search and sharding against plain versions, and the pipeline on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolane.llm import filter_audit, pii, ranked_search, sharding
from chronolane.llm.registry import oracle_sql, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, n long, a boolean, shard int, size string, rank int"
LONG = "Many words & more, " * 20_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(extra=()):
    rows = [
        (1, "a b c", "en"), (1, "a b c", "en"), (2, None, None), (3, "", "en"), (4, LONG, "de"), (5, LONG, ""), (6, "UPPER CASE TEXT", "en"), (None, "a b c", "fr"), (None, None, "fr"),
        (7, " \t\n\x0b", "en"), (8, "é\xa0ß 中文　x\x1c" * 60, "zh"), (9, "a b c", "fr"), (-4, "word " * 150, "en"), (10, " ".join(f"w{k}" for k in range(120)), "en"), *extra,
    ]
    return [(i, t, g, "src1", 0, "x", 9, True, 3, "s", 2) for i, t, g in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op8_ngram_jaccard_join", "op11_filter_interaction_audit", "op12_ranked_lexical_search", "op13_sampled_splitters"])
def test_query_equals_its_sql(spark, name):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    rows = got.select(*want.columns).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want.fetchall())) and rows


def audited(rows, labels):
    """Every row through every order."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, lang, *_ in rows:
        t, ws = t or "", WORD.findall(t or "")
        flags = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((lang or "", {k for k, v in flags.items() if v}, i in good, i in toxic))
    out = []
    for part in {p for p, *_ in fails}:
        own = [f for f in fails if f[0] == part]
        removed = Counter()
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, k in enumerate(order):
                gone = [f for f in alive if k in f[1]]
                alive = [f for f in alive if k not in f[1]]
                removed[k] += len(gone)
                out.append([part, "".join(order), step + 1, len(alive), len(gone), sum(k in f[1] for f in own) - len(gone), sum(f[1] == {k} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)])
        for r in out[-600:]:
            r.append(removed[r[1][r[2] - 1]])
    return sorted(map(tuple, out))


def test_audit_of_awkward_rows(spark, docs, empty):
    marks = [(1, 1, 0), (1, 0, 1), (4, None, 1), (5, 1, None), (None, 1, 1), (6, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filter_audit.audit(docs, labels)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == audited(awkward(), marks)
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_deals_one_hot_text_apart(spark):
    """A third of the rows hold one text: no key of a shuffle join is the text alone."""
    rows = [(k, "hot text" if k % 3 == 0 else f"text {k}", "en") for k in range(3000)]
    got = {r["filter_order"]: r["removed"] for r in filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("step = 1").collect()}
    assert got["EABCD"] == 999 and got["ABCDE"] == 3000


def searched(rows, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t, *_ in rows]
    n = sum(bool(c) for _, c in held)
    length = sum(sum(c.values()) for _, c in held)
    df = Counter(x for _, c in held for x in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, q in asked.items():
        found = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n) // length if length else 0
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 12 * m)) for x, times in q.items() if c[x])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_search_of_awkward_rows(spark, docs, empty, monkeypatch):
    items = [(1, "a B c, many words"), (2, None), (3, ""), (4, "é ß 中文 X"), (1, "Words"), (5, "nothing_here of it"), (6, "w1 w2 w3 upper")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(ranked_search.search(docs, asked).collect()) == searched(awkward(), items)
    assert ranked_search.search(empty, asked).count() == 0 and ranked_search.search(docs, asked.limit(0)).count() == 0
    # the query set in blocks: the same result
    monkeypatch.setattr(ranked_search, "ITEMS", 2)
    assert key(ranked_search.search(docs, asked).collect()) == searched(awkward(), items)


def test_search_with_ties_and_many_copies(spark):
    rng = random.Random(8)
    word = lambda: f"t{min(int(rng.expovariate(0.08)), 90)}"
    rows = [(k, " ".join(word() for _ in range(rng.choice([3, 20, 200])))) for k in range(900)]
    rows += [(1000 + k, rows[3][1]) for k in range(400)] + [(5, rows[5][1])] * 30
    rng.shuffle(rows)
    items = [(k, " ".join(word() for _ in range(8))) for k in range(30)] + [(77, rows[3][1])]
    got = ranked_search.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == searched(rows, items)


def test_pieces_and_accumulation():
    data = b" ".join(b"word%d" % k for k in range(3000))
    assert [w for ws in ranked_search.pieces(data, 100) for w in ws] == data.split() and list(ranked_search.pieces(b"")) == []
    rng = np.random.default_rng(0)
    item, doc, impact = rng.integers(0, 9, 5000).astype(np.uint16), np.sort(rng.integers(0, 70_000, 5000)), rng.integers(0, 100, 5000)
    want = Counter()
    for i, d, x in zip(item.tolist(), doc.tolist(), impact.tolist()):
        want[i, d] += x
    got = {(i, d): s for i, d, s in zip(*(x.tolist() for x in ranked_search.accumulate(item, doc, impact)))}
    assert got == want


def sharded(rows, shards=8):
    def key(r):
        return int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0

    total, start, slots, out = sum(len((t or "").encode()) + 1 for _, t, *_ in rows), 0, Counter(), []
    for i, t, *_ in sorted(rows, key=key):
        data = (t or "").encode()
        shard = (2 * start + len(data) + 1) * shards // (2 * total)
        out.append((i, len(data) + 1, zlib.crc32(data), "bytes", shard, slots[shard], None))
        slots[shard] += 1
        start += len(data) + 1
    return sorted(map(str, out))


@pytest.mark.parametrize("splits,most", [(256, 1 << 22), (16, 20), (4, 60)])
def test_shards_of_awkward_rows_and_overfull_ranges(spark, empty, splits, most):
    """A hot text, rows equal in all of their key, and sizes of ranges that have to be subdivided again and again."""
    rows = awkward([(100 + k, "hot", "en") for k in range(300)] + [(None, "hot", "en")] * 100 + [(50, "same", "en")] * 100 + [(1000 + k, "x" * (k % 90), "en") for k in range(300)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.shard(df, splits=splits, most=most)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(str(tuple(r)) for r in got.collect()) == sharded(rows)
    placed, ranges = sharding.ranged(sharding.sized(df), splits, most)
    assert ranges["rows"].max() <= most and ranges["rows"].sum() == len(rows)
    assert sharding.shard(empty, splits=splits, most=most).count() == 0


def test_shards_are_near_equal_in_bytes(spark):
    rng = random.Random(2)
    rows = [(k, "y" * rng.randrange(2000)) for k in range(4000)] + [(5000 + k, "z" * 900) for k in range(2000)]
    held = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    share = sum(len(t) + 1 for _, t in rows) / 8
    assert len(held) == 8 and all(abs(r["bytes"] - share) <= 2000 for r in held)


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.2.3", "1.2.3." + "0" * 4400, "1.2." + "0" * 9000 + "255.4", "9" * 9000, "1." * 9000, "+" + "1" * 9000, "4" + "1 " * 9000])
def test_long_runs_of_digits(text):
    found = pii.find(text)
    base = re.search(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    assert any(k == "ip" for k, *_ in found) == bool(base)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(None, "no id of its own, mail a@b.cd", "en", "src1", 5), (None, None, None, None, None), (3, texts[3], "en", "src0", 9), (3, "0" * 5000 + ".1.2.3 and other words", "en", "src0", 9), (200, "", "en", "src1", 0), (201, None, "en", "src1", 0), (202, "deep " * 400_000, "de", "src2", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for name, given in (("full", rows), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(given, schema).withColumns({"score": F.lit(1), "ids": F.lit("x"), "held_out": F.lit(True)}).write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        out = cp.run(spark, sf).collect()
        if name == "none":
            assert out == []
            continue
        assert out and all(r["n_tokens"] == len(r["ids"]) for r in out)
        kept = [r["doc_id"] for r in out]
        assert len(set(kept) & set(range(60))) >= 45 and len(kept) <= len(rows)


def test_a_giant_first_row_does_not_stop_the_subdivision(spark):
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    texts = sorted((f"text {k}" for k in range(9)), key=digest)
    giant = next(t for t in ("g" * (9000 + k) for k in range(999)) if digest(t) < digest(texts[0]))
    rows = list(enumerate([giant, *texts]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in sharding.shard(df, splits=4, most=3).collect()) == sharded(rows)

"""Similarity join, neighbours, mixing and the pipeline against plain versions."""

import random
import re

import duckdb
import numpy as np
import pytest

from chronolane.llm import ann, components, jaccard, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, grp string"


def plain_components(rows):
    sets = []
    for _, t in rows:
        ws = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 30))
    passage = " ".join(word() for _ in range(55))
    rows, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 8])):
            ws = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                ws[rng.randrange(len(ws))] = word()
            if rng.random() < 0.3:
                ws.append(passage)
            rows.append((i, " ".join(ws)))
            i += rng.randint(1, 3)
    # many near copies of one text, and exact ones
    base = [word() for _ in range(80)]
    for k in range(60):
        ws = list(base)
        for _ in range(k % 5):
            ws[rng.randrange(len(ws))] = word()
        rows.append((i + k, " ".join(ws)))
    rows += [(5000 + k, rows[0][1]) for k in range(20)]
    rows += [(6000, None), (6001, ""), (6002, " \t"), (6003, "One two"), (6004, "one  TWO"), (6005, "w " * 30000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_similarity_join_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "n", "g") for d, t in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in jaccard.similar_sets(spark, docs).collect())
    assert got == plain_components(rows)
    kept = jaccard.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in got})


def test_similarity_join_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, "x")], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.similar_sets(spark, docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (3, 1, 3)], key=str)
    # the row without an id is a copy of a kept one
    assert sorted(str(r["doc_id"]) for r in jaccard.one_of_each(spark, docs).collect()) == ["1", "3"]
    assert jaccard.similar_sets(spark, docs.limit(0)).count() == 0 and jaccard.one_of_each(spark, docs.limit(0)).count() == 0


def test_similarity_join_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(40)]
    near = lambda k: " ".join([*base[:k], "other", *base[k + 1 :]])
    rows = [(1, near(0)), (None, " ".join(base)), (2, near(39)), (None, "alone text here"), (None, None), (None, ""), (5, "one thing and five words"), (5, "quite another text of six words"), (6, "one thing and five words"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.similar_sets(spark, docs).collect()), key=str)
    # 1 and 2 are linked by the row without an id alone
    assert got == sorted([(1, 36, 1), (None, 36, 1), (2, 36, 1), (None, 1, None), (None, 0, None), (None, 0, None), (5, 1, 5), (5, 2, 5), (6, 1, 5), (7, 0, 7)], key=str)
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in jaccard.one_of_each(spark, docs).collect())
    assert kept == sorted([("1", near(0)), ("None", "alone text here"), ("None", ""), ("None", ""), ("5", "one thing and five words"), ("5", "quite another text of six words"), ("7", "")])


def test_similarity_join_hot_lists_and_copies(spark):
    """Thousands of copies of one text, and a prefix list of many texts that are not linked."""
    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(45))) for i in range(1500)]
    rows += [(2000 + i, "copy " + shared) for i in range(3000)] + [(6000, "copy! " + shared)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_sets(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == {i: i for i in range(1500)} | {2000 + i: 2000 for i in range(3000)} | {6000: 2000}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 100), (7, 7), (200, 201), (202, 201)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 100: 90, 200: 200, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(rng.standard_normal((3000, 24)))]
    rows += [(4000 + i, rows[50][1], 1) for i in range(300)]  # one vector of many rows
    odd = [(9000, None, 1), (9050, [0.0] * 24, 1), (9100, [float("nan")] * 24, 1), (9150, [None] + [1.0] * 23, 1), (9200, [1.0, 2.0], 1), (9250, [float("inf")] * 24, 1)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, list int")
    got = {}
    for r in ann.search(vectors, vectors.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    norm = np.linalg.norm(x, axis=1)
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        at = int(np.flatnonzero(ids == q)[0])
        s = x @ x[at] / (norm * norm[at])
        s[at] = -9
        best = ids[np.lexsort((ids, -np.round(s, 12)))][:5]
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(f[2] - s[int(np.flatnonzero(ids == f[1])[0])]) < 1e-12 for f in found)
        hits += len(set(best.tolist()) & {f[1] for f in found})
    assert hits / (5 * len(got)) >= 0.9
    assert [f[1] for f in got[50]] == [4000, 4001, 4002, 4003, 4004]
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1)]


def test_neighbours_of_outliers_are_whole(spark, monkeypatch):
    """Clusters, so that few lists are probed, and lone vectors whose own list holds too few; queries of a list in several parts."""
    monkeypatch.setattr(ann, "QUERIES", 3)
    rng = np.random.default_rng(11)
    centres = 8 * rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 2500)] + 0.1 * rng.standard_normal((2500, 16))
    x[::50][:6] = 8 * rng.standard_normal((6, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(vectors, vectors.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(range(0, 2500, 50))
    for q, found in got.items():
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5] and len({f[1] for f in found}) == 5
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & {f[1] for f in found})
    assert hits / (5 * len(got)) >= 0.9


def test_neighbours_of_every_length_and_size(spark, monkeypatch):
    """Two lengths with an index each, a third in one list, and components whose squares overflow or vanish."""
    monkeypatch.setattr(ann, "BLOCK", 400)
    rng = np.random.default_rng(7)
    x = {d: rng.standard_normal((n, d)) for d, n in ((24, 1200), (40, 900), (7, 60))}
    scale = [1.0, 1e200, 1e-200, 1e-310]
    rows, at, members = [], 0, {}
    for d, vectors in x.items():
        for v in vectors:
            members.setdefault(d, []).append(at)
            rows.append((at, (v * scale[at % 4]).tolist()))
            at += 1
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(vectors, vectors.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, at, 50))
    hits = 0
    for d, ids in members.items():
        plain = np.array([rows[i][1] for i in ids])
        plain = plain / np.abs(plain).max(axis=1, keepdims=True)
        plain /= np.linalg.norm(plain, axis=1, keepdims=True)
        for q in ids:
            if q in got:
                s = plain @ plain[q - ids[0]]
                s[q - ids[0]] = -9
                assert sorted(f[0] for f in got[q]) == [1, 2, 3, 4, 5] and all(abs(f[2] - s[f[1] - ids[0]]) < 1e-12 for f in got[q])
                hits += len({ids[i] for i in np.argsort(-s)[:5]} & {f[1] for f in got[q]})
    assert hits / (5 * len(got)) >= 0.9


def test_mixing_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(f"select doc_id, domain, lang, source, epoch, n_tokens, taken from ({mixing.MIXTURE_SQL})").fetchall()
    got = mixing.mixture(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300


def test_mixing_awkward_rows(spark):
    rows = [(1, "a b c", "en", "src1", "x"), (1, "a b c", "en", "src1", "x"), (2, None, "en", "src1", "x"), (3, "", None, None, None), (4, "q " * 50, None, None, None), (None, "z z", "fr", "odd", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string")
    out = mixing.mixture(docs, 1.0, 1).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in out) == [("1", 3), ("1", 3), ("4", 51), ("None", 2)]
    assert mixing.mixture(docs.limit(0)).count() == 0
    kept = mixing.selected(docs, 1.0)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "4", "None"]


def test_shortage_goes_to_siblings_first(spark):
    from pyspark.sql import functions as F

    leaves = spark.createDataFrame([("d0", "en", "a", 10, 1), ("d0", "en", "b", 1000, 1), ("d0", "fr", "c", 1000, 1), ("d1", "en", "d", 1000, 1)], "domain string, lang string, source string, size long, rows long")
    one = {k: F.lit(1) for k in mixing.LEAF}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, F.lit(800), one, 1).collect()}
    # the half of d0 is 400, of its languages 200 each; what `a` lacks of 100 goes to `b` alone
    assert got == {"a": 10, "b": 190, "c": 200, "d": 400}


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline as cp
    from chronolane.llm import bpe, pii
    from chronolane.llm.registry import vocabulary
    from chronolane.llm.shared import documents

    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    clean = cp.reject_toxic(spark, docs, sf)
    rows = [tuple(r) for r in clean.collect()]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    assert clean.columns == docs.columns and len(rows) < docs.count()
    assert len({r[0] for r in rows} & toxic) <= len(toxic) / 2
    plain = plain_components([(r[0], r[1]) for r in rows])
    stay = {c for _, _, c in plain}
    masked = {r[0]: pii.masked(r[1], pii.find(r[1])) for r in rows if r[0] in stay}
    table = spark.createDataFrame([(i, t, *next((r[2], r[3]) for r in rows if r[0] == i)) for i, t in masked.items()], "doc_id long, text string, lang string, source string")
    taken = {r["doc_id"] for r in mixing.mixture(table, cp.MIX_SHARE, 1).collect()}
    codec = bpe.codec(vocabulary())
    want = sorted((i, codec.tokenizer.encode(masked[i], add_special_tokens=False).ids) for i in taken)
    got = sorted((r["doc_id"], list(r["ids"])) for r in cp.run(spark, sf).collect())
    assert got == want and len(got) > 50

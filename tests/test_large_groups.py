"""Operators that spread large groups over tasks, against plain versions."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolane.functions import canonical
from chronolane.operators import constraints, graphs, identity, intervals, market, plugins, ranks, revisions, splits, timing


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


# identities in order of arrival

COLUMNS = ("case", "seq", "official", "competition", "home", "away", "kickoff", "zone", "source")
STRUCTURAL = ("competition", "home", "away", "kickoff")


def replayed(rows):
    """One row after the other, as a store would take them."""
    by_official, by_shape, accepted, out = {}, {}, {}, {}
    for row in sorted(rows, key=lambda r: r["seq"]):
        shape = tuple(row[c] for c in STRUCTURAL)
        delivery = tuple(row[c] for c in COLUMNS if c not in ("seq", "case"))
        if delivery in accepted:
            out[row["seq"]] = ("DUPLICATE_NOOP", accepted[delivery], [])
            continue
        root = by_official.get(row["official"]) if row["official"] is not None else None
        name = "SOURCE_ALIAS"
        if root is None:
            root, name = by_shape.get(shape), "CROSS_SOURCE_ALIAS"
        if root is None and row["official"] is None:
            out[row["seq"]] = ("BLOCKED_MISSING_OFFICIAL_REF", None, [])
            continue
        if root is None:
            by_official[row["official"]] = by_shape[shape] = root = row
            out[row["seq"]] = ("ROOT_CREATED", row["seq"], [])
        else:
            codes = sorted({code for c, code in identity.COMPARED.items() if row[c] != root[c]})
            out[row["seq"]] = ("BLOCKED_CONFLICT" if codes else name, root["seq"], codes)
        if not out[row["seq"]][2]:
            accepted[delivery] = root["seq"]
    return out


def test_arrivals_are_those_of_a_sequential_replay(spark):
    rng, rows, want = random.Random(4), [], {}
    for case in range(60):
        own = []
        for _ in range(rng.choice([1, 4, 12, 30])):
            spread = rng.choice([2, 4])
            own.append({"case": case, "seq": 100 * case + len(own), "official": rng.choice([None, *(f"{case}:{k}" for k in range(spread))]), "competition": f"{case}/{rng.randrange(spread)}", "home": rng.choice([None, 1, 2]), "away": 3, "kickoff": rng.choice([None, 0, 0, 1]), "zone": rng.choice([0, 0, 0, 1, None]), "source": rng.choice("ab")})
        rows += own
        want |= replayed(own)
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], "case long, seq long, official string, competition string, home long, away long, kickoff long, zone long, source string").repartition(5)
    got = identity.arrivals(df, "seq", "official", list(STRUCTURAL), identity.COMPARED, [c for c in COLUMNS if c not in ("seq", "case")])
    assert {r["seq"]: (r["action"], r["root"], sorted(r["conflicts"])) for r in got.collect()} == want
    assert {a for a, _, _ in want.values()} == {"ROOT_CREATED", "SOURCE_ALIAS", "CROSS_SOURCE_ALIAS", "BLOCKED_CONFLICT", "BLOCKED_MISSING_OFFICIAL_REF", "DUPLICATE_NOOP"}
    assert identity.arrivals(df.limit(0), "seq", "official", list(STRUCTURAL), identity.COMPARED, ["official"]).count() == 0


def test_first_pairs_of_a_chain_in_which_each_waits_for_the_one_before(spark):
    pairs = spark.createDataFrame([(k // 2 + k % 2, k // 2, k) for k in range(12)], "b long, s long, q long")
    assert sorted(r["q"] for r in identity.first_pairs(pairs).collect()) == [0, 2, 4, 6, 8, 10]


# ranks


def test_ranks_of_one_group_take_many_tasks_and_equal_the_window(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(k, rng.choice([None, *range(40)]), rng.choice(["a", "a", "a", None, "b"])) for k in range(5000)], "id long, x long, g string").repartition(4)
    for by in ([], ["g"]):
        got = splits.floor_thirds(df, by, "x", "id")
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        i, n = F.row_number().over(w.orderBy("x", "id")) - 1, F.count("*").over(w)
        want = df.withColumns({"i": i, "n": n}).select("id", F.when(F.col("i") < F.floor(F.col("n") / 3), "train").when(F.col("i") < F.floor(2 * F.col("n") / 3), "validation").otherwise("test").alias("partition"))
        assert sorted(map(tuple, got.select("id", "partition").collect())) == sorted(map(tuple, want.collect()))
    # so small a table is one piece, unless small partitions are left as they are
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    at = ranks.ranked(df, [], ["x", "id"])
    assert sorted((r["before"], r["total"]) for r in at.collect()) == [(k, 5000) for k in range(5000)]
    assert at.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    before = ranks.previous(df, ["g"], ["x", "id"], {"last": "id"})
    assert sorted(map(str, before.select("id", "last").collect())) == sorted(map(str, df.withColumn("last", F.lag("id").over(Window.partitionBy("g").orderBy("x", "id"))).select("id", "last").collect()))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = ranks.previous(df, ["g"], ["x", "id"], {"last": "id"})
    want = df.withColumn("last", F.lag("id").over(Window.partitionBy("g").orderBy("x", "id")))
    assert sorted(map(str, before.select("id", "last").collect())) == sorted(map(str, want.select("id", "last").collect()))


def test_one_market_with_every_row(spark):
    """Median, hinges and deviation of a market of 3,000 providers beside small ones, and no array of a market in the plan."""
    rng = np.random.default_rng(3)
    prices = {"hot": np.round(rng.exponential(3, 3000), 2) + 0.01, "one": np.array([2.5]), "two": np.array([1.0, 4.0]), "three": np.array([1.0, 2.0, 9.0])}
    rows = [(0, k, m, float(x), day(1), None) for m, xs in prices.items() for k, x in enumerate(xs)]
    rows += [(1, 7, "none", -1.0, day(1), None), (2, 7, "none", None, day(1), None)]
    q = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "quote_id long, provider long, market string, price double, source_time timestamp_ntz, line int").repartition(4)
    agg = market.provider_aggregate(q)
    assert "collect_list" not in agg._jdf.queryExecution().toString()
    got = {r["market"]: r for r in agg.collect()}
    for m, xs in prices.items():
        half, xs = len(xs) // 2, np.sort(xs)
        iqr = float(np.median(xs[len(xs) - half :]) - np.median(xs[:half])) if half else 0.0
        assert (got[m]["eligible"], got[m]["median"], got[m]["iqr"]) == (len(xs), pytest.approx(np.median(xs)), pytest.approx(iqr))
        assert got[m]["mad"] == pytest.approx(np.median(np.abs(xs - np.median(xs))))
    assert (got["none"]["eligible"], got["none"]["excluded"], got["none"]["median"]) == (0, 2, None)


# fits


def test_newton_fit_of_parts(spark):
    """A logistic fit for each role from terms of a Newton step, summed over parts of a table, against one in memory."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal(6000)
    role = np.where(rng.random(6000) < 0.8, "a", "b")
    y = (rng.random(6000) < 1 / (1 + np.exp(-(0.5 + np.where(role == "a", 2.0, -1.0) * x)))).astype(float)
    df = spark.createDataFrame(list(zip(role.tolist(), x.tolist(), y.tolist())), "role string, x double, y double").repartition(7)

    def partial(rows, model):
        w, c = (model["w"], model["c"]) if model else (0.0, 0.0)
        p = 1 / (1 + np.exp(-(w * rows["x"] + c)))
        v, e = p * (1 - p), rows["y"] - p
        return [(v * rows["x"] ** 2).sum(), (v * rows["x"]).sum(), v.sum(), (e * rows["x"]).sum(), e.sum()]

    def finish(s, model):
        step = np.linalg.solve([[s[0], s[1]], [s[1], s[2]]], s[3:])
        return {"w": (model["w"] if model else 0.0) + step[0], "c": (model["c"] if model else 0.0) + step[1]}

    got = {r["role"]: (r["w"], r["c"]) for r in plugins.fit_parts(df, ["role"], partial, 5, finish, "w double, c double", 8).collect()}
    for r in "ab":
        w = np.zeros(2)
        z = np.column_stack((x[role == r], np.ones((role == r).sum())))
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ w))
            w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y[role == r] - p))
        assert got[r] == pytest.approx(tuple(w), rel=1e-6)


def test_fit_of_null_keys_and_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "role string, x double")
    fit = lambda rows: plugins.fit_parts(rows, ["role"], lambda g, _: (len(g), g["x"].sum()), 2, lambda s, _: {"mean": s[1] / s[0]}, "mean double")
    assert {r["role"]: r["mean"] for r in fit(df).collect()} == {None: 2.0, "a": 5.0}
    assert fit(df.limit(0)).count() == 0


# graphs


def test_levels_of_a_long_chain_beside_a_cycle_and_diamonds(spark):
    edges = [(k, k - 1) for k in range(1, 10_000)]  # a chain
    edges += [(20_000, 20_002), (20_001, 20_000), (20_002, 20_001), (20_003, 20_002), (20_004, 20_003), (20_004, 5), (20_005, 20_005)]  # a ring, what is behind it, a loop
    for k in range(30_000, 30_300, 3):  # a chain of diamonds
        edges += [(k + 1, k), (k + 2, k), (k + 3, k + 1), (k + 3, k + 2)]
    nodes = sorted({n for e in edges for n in e} | {99_999}) + [5]
    edges += [(7, 123_456), (123_457, 7), (7, 6)]  # unlisted nodes, and an edge again
    left, levels = set(nodes), {}
    up = {}
    for a, b in edges:
        if a in left and b in left:
            up.setdefault(a, set()).add(b)
    ready = [n for n in left if n not in up]
    down = {}
    for a, bs in up.items():
        for b in bs:
            down.setdefault(b, []).append(a)
    open_edges = {a: len(bs) for a, bs in up.items()}
    while ready:
        n = ready.pop()
        levels[n] = 1 + max((levels[b] for b in up.get(n, ())), default=-1)
        for a in down.get(n, ()):
            open_edges[a] -= 1
            if not open_edges[a]:
                ready.append(a)
    got = graphs.levels(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "node long, parent long").repartition(4))
    found = {r["node"]: r["level"] for r in got.collect()}
    assert found == {n: levels.get(n) for n in set(nodes)} and found[9999] == 9999 and found[30_300] == 200 and found[20_004] is None


def test_edges_that_point_forward_or_nowhere(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "node string, position int")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("c", "x"), ("b", "b"), ("q", "a")], "node string, parent string")
    assert sorted(map(tuple, graphs.edge_states(nodes, edges).collect())) == [("a", "c", "FORWARD_REFERENCE"), ("b", "a", "OK"), ("b", "b", "FORWARD_REFERENCE"), ("c", "b", "OK"), ("c", "x", "PARENT_MISSING")]


# intervals


def test_intervals_that_meet(spark):
    rng = random.Random(9)

    def some(n, name):
        rows = []
        for k in range(n):
            start = rng.randrange(-300, 3000)
            length = rng.choice([0, 0, 1, 2, 7, 60, 700, -1])
            rows.append((k, rng.choice([1, 2, None]), day(start) if rng.random() > 0.02 else None, day(start + length) + dt.timedelta(seconds=rng.randrange(3))))
        return rows, spark.createDataFrame(rows, f"{name} long, team int, {name}_from timestamp_ntz, {name}_to timestamp_ntz")

    (a, left), (b, right) = some(400, "a"), some(500, "b")
    meets = lambda x, y: x[2] is not None and y[2] is not None and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
    pairs = intervals.meeting(left, right.drop("team"), ("a_from", "a_to"), ("b_from", "b_to"))
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == sorted((x[0], y[0]) for x in a for y in b if meets(x, y))
    keyed = intervals.meeting(left, right, ("a_from", "a_to"), ("b_from", "b_to"), ["team"])
    assert "NestedLoop" not in keyed._jdf.queryExecution().toString() and "CartesianProduct" not in pairs._jdf.queryExecution().toString()
    assert sorted((r["a"], r["b"]) for r in keyed.collect()) == sorted((x[0], y[0]) for x in a for y in b if meets(x, y) and x[1] is not None and x[1] == y[1])
    assert intervals.meeting(left, right.limit(0), ("a_from", "a_to"), ("b_from", "b_to"), ["team"]).count() == 0


# chains, change sets, clocks, JSON


def test_one_altered_entry_of_a_long_chain_is_found(spark):
    rows = spark.createDataFrame([("e", k, f"p{k}") for k in range(700)] + [("f", 1, "x"), ("f", 2, None)], "entity string, at long, payload string")
    chain = revisions.audit_chain(rows, ["entity"], ["at"], "payload").select("entity", "at", "payload", "prev_hash", "entry_hash")
    check = lambda c: {(r["entity"], r["at"]): r["broken"] for r in revisions.verified_chain(c, ["entity"], ["at"], "payload").collect() if r["broken"]}
    assert check(chain) == {}
    altered = chain.withColumn("payload", F.when((F.col("entity") == "e") & (F.col("at") == 345), "other").otherwise(F.col("payload")))
    assert check(altered) == {("e", 345): ["ENTRY_MISMATCH"]}
    made = F.sha2(F.concat(F.coalesce("prev_hash", F.lit("")), F.lit("|"), F.sha2("payload", 256)), 256)
    rehashed = altered.withColumn("entry_hash", F.when(F.col("at") == 345, made).otherwise(F.col("entry_hash")))
    assert check(rehashed) == {("e", 346): ["LINK_BROKEN"]}
    assert check(chain.where("at != 345")) == {("e", 346): ["LINK_BROKEN"]}
    trees = [revisions.digest_tree(c, ["entity"], ["at"], fan=8) for c in (chain, rehashed)]
    assert [tuple(r) for r in revisions.first_differing(*trees, ["entity"]).collect()] == [("e", 345 // 8)]
    assert {(r["entity"], r["level"]): r["n"] for r in trees[0].groupBy("entity", "level").agg(F.count("*").alias("n")).collect()} == {("e", 0): 88, ("e", 1): 11, ("e", 2): 2, ("e", 3): 1, ("f", 0): 1}


def test_change_sets_and_their_guards(spark):
    schema = "id long, status string, immutable boolean, frozen_at timestamp_ntz, kickoff_at timestamp_ntz, odds double"
    base = [(k, "DRAFT", False, None, day(9), 1.5) for k in range(10)] + [(10, "FROZEN", True, day(1), day(9), 1.5)]
    after = {k: list(r) for k, *_ in base for r in [base[k]]}
    after[0][1:4] = ["FROZEN", True, day(2)]
    after[1][1:4] = ["FROZEN", False, day(2)]
    after[2][1:4] = ["SUPERSEDED", True, None]
    after[3][1:4] = ["FROZEN", True, day(9)]
    after[4][5] = 1.6
    after[5][1:4] = ["FROZEN", True, day(2)]  # outside the gate
    del after[6]
    after[10][1] = "DRAFT"
    after[11] = [11, "DRAFT", False, None, day(9), None]
    changes = constraints.change_set(spark.createDataFrame(base, schema), spark.createDataFrame([tuple(r) for r in after.values()], schema), ["id"])
    guarded = constraints.frozen_guard(changes, F.when(F.col("id") != 5, "FREEZE_GATE"))
    got = {r["id"]: (r["change"], r["refused"], r["touched"]) for r in guarded.collect()}
    assert got == {
        0: ("UPDATE", None, []), 1: ("UPDATE", "FROZEN_INPUT_STATUS_REQUIRES_IMMUTABLE", []), 2: ("UPDATE", "FROZEN_INPUT_IMMUTABLE_REQUIRES_FROZEN_AT", []), 3: ("UPDATE", "FROZEN_INPUT_FREEZE_MUST_PRECEDE_KICKOFF", []),
        4: ("UPDATE", "FROZEN_INPUT_IDENTITY_FIELDS_ARE_IMMUTABLE", ["odds"]), 5: ("UPDATE", "FROZEN_INPUT_MUTATION_OUTSIDE_GATE", []), 6: ("DELETE", "FROZEN_INPUT_DELETE", []),
        7: ("SAME", None, []), 8: ("SAME", None, []), 9: ("SAME", None, []), 10: ("UPDATE", "FROZEN_INPUT_MUTATION", []), 11: ("INSERT", None, []),
    }
    assert {r["id"]: r["refused"] for r in constraints.append_only(changes).collect() if r["refused"]} == {6: "APPEND_ONLY_DELETE", **dict.fromkeys([0, 1, 2, 3, 4, 5, 10], "APPEND_ONLY_UPDATE")}
    with pytest.raises(Exception, match="FROZEN_INPUT"):
        constraints.enforced(guarded).collect()
    assert constraints.enforced(guarded.where("refused is null")).count() == 5


def test_freshness_ladder(spark):
    rows = [
        ((None, None, None, 5, None, None), "UNKNOWN_TIME", ["VALID_FROM_UNKNOWN_TIME"]), ((6, None, None, 5, None, None), "FUTURE_DATA", ["VALID_FROM_AFTER_AS_OF"]),
        ((1, 5, 1, 5, None, None), "CURRENT", []), ((1, 4, 1, 5, None, None), "STALE", ["EXPIRED"]), ((1, None, 1, 5, 6, 6), "BLOCKED", ["CUTOFF_NOT_BEFORE_KICKOFF"]),
        ((1, None, 7, 5, 6, 8), "FUTURE_DATA", ["NOT_ELIGIBLE_AT_CUTOFF"]), ((1, None, 6, 5, 6, 8), "CURRENT", []), ((None, 1, 1, 5, 6, 6), "FUTURE_DATA", ["VALID_FROM_UNKNOWN_TIME", "CUTOFF_NOT_BEFORE_KICKOFF", "NOT_ELIGIBLE_AT_CUTOFF"]),
    ]
    df = spark.createDataFrame([(i, *(None if x is None else day(x) for x in r)) for i, (r, _, _) in enumerate(rows)], "i int, v timestamp_ntz, e timestamp_ntz, r timestamp_ntz, a timestamp_ntz, c timestamp_ntz, k timestamp_ntz")
    got = sorted((r["i"], r["f"]["state"], r["f"]["blockers"]) for r in df.select("i", timing.freshness("v", "e", "r", "a", "c", "k").alias("f")).collect())
    assert got == [(i, s, b) for i, (_, s, b) in enumerate(rows)]


def test_json_of_any_depth(spark):
    deep = lambda n, inner: '{"a":[' * n + inner + "]}" * n
    texts = ['{"x": {"secret": 1}}', deep(200_000, '{"secret":1}'), deep(200_000, "1"), deep(3_000, '{"b":[1,{"secret":{}}]}'), "{" * 100_000, '["secret", {"y": "\\"secret\\":"}]', None, "no", '[{"sec\\u0072et": 2}]']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: (r["p"], r["c"]) for r in df.select("i", canonical.forbidden_path(("secret",))("t").alias("p"), canonical.canonical_json("t").alias("c")).collect()}
    assert [got[i][0] for i in (0, 2, 4, 5, 6, 7, 8)] == ["$.x.secret", None, None, None, None, None, "$[0].secret"]
    assert got[1][0] == "$" + ".a[0]" * 200_000 + ".secret" and got[3][0].endswith(".b[1].secret")
    assert got[0][1] == '{"x":{"secret":1}}' and got[1][1] is None and got[8][1] == '[{"secret":2}]'
    # both readers give one path
    rng = random.Random(2)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice([1, "secret", None, "a,b:{", 2.5])
        return {rng.choice(["k", "l", "secret", 'q"]']): value(depth - 1) for _ in range(rng.randrange(3))} if kind < 0.7 else [value(depth - 1) for _ in range(rng.randrange(4))]

    for _ in range(2000):
        v = value(5)
        assert canonical.deep_path(json.dumps(v), ("secret",)) == canonical.path_of(v, ("secret",))

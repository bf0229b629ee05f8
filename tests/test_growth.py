"""Whole jobs whose cost follows their input, on rows small enough to check by hand or by a plain version."""

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from chronolane import catalog


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_layout_is_matched_by_all_bars(spark, tmp_path):
    """A bar between the two, a missing one or an unknown one does not fit, whatever the least and the greatest are."""
    rows = [(1, 10.0), (1, 30.0), (2, 10.0), (2, 20.0), (2, 30.0), (3, 15.0), (4, None), (4, 10.0), (5, 38.0), (5, 2.0), (6, 10.0), (6, 39.0), (7, 10.0), (7, 30.0), (7, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["image"]: r["fits"] for r in catalog.queries()["layout_match"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: False}
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert dict(con.sql(catalog.oracle_sql()["layout_match"]).fetchall()) == got


def test_totals_over_what_meets_are_those_of_the_pairs(spark):
    """Intervals of any length, unit, order and sign, with nulls; and as many equal ones as would make 4 million pairs."""
    from chronolane.operators import intervals

    rng = random.Random(3)
    totals = {"n": (F.sum, F.lit(1)), "least": (F.min, "b"), "most": (F.max, "b"), "sum": (F.sum, F.col("b") * 2)}
    for part in (dt.timedelta(0), dt.timedelta(hours=5), dt.timedelta(microseconds=1)):

        def some(n, name):
            rows = []
            for k in range(n):
                start, length = rng.randrange(-25_000, -22_000), rng.choice([0, 0, 1, 2, 7, 60, 700, -1])
                low = day(start) + rng.randrange(3) * part
                rows.append((k, rng.choice([1, 2, None]), low if rng.random() > 0.02 else None, low + dt.timedelta(days=length) + rng.randrange(3) * part))
            return rows, spark.createDataFrame(rows, f"{name} long, team int, {name}_from timestamp_ntz, {name}_to timestamp_ntz")

        (a, left), (b, right) = some(300, "a"), some(400, "b")
        meets = lambda x, y: None not in (x[1], x[2], y[2]) and x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
        want = {x[0]: [y[0] for y in b if meets(x, y)] for x in a}
        got = intervals.meeting_totals(left, right, ("a_from", "a_to"), ("b_from", "b_to"), ["team"], totals)
        assert sorted((r["a"], r["n"], r["least"], r["most"], r["sum"]) for r in got.collect()) == sorted((k, len(v), min(v), max(v), 2 * sum(v)) for k, v in want.items() if v)
        assert intervals.meeting_totals(left, right.limit(0), ("a_from", "a_to"), ("b_from", "b_to"), ["team"], totals).count() == 0


def test_evidence_is_never_paired_with_facts(spark, tmp_path):
    """2,000 facts of 2,000 pieces of evidence each: no step of the plan makes as many rows as there are pairs."""
    o = spark.range(2000).select(F.col("id").alias("o_orderkey"), (F.col("id") * 100).alias("o_custkey"), F.lit(day(0)).cast("timestamp_ntz").alias("o_orderdate"))
    x = spark.range(2000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") * 100).alias("l_suppkey"), F.lit(day(0)).cast("timestamp_ntz").alias("l_shipdate"), F.lit(3.0).alias("l_quantity"))
    o.write.parquet(str(tmp_path / "orders.parquet"))
    x.write.parquet(str(tmp_path / "lineitem.parquet"))
    df = catalog.queries()["evidence_validity"](spark, str(tmp_path))
    assert df.agg(F.min("evidence"), F.max("first_order"), F.sum("lines")).first()[:] == (2000, 0, 4_000_000)
    rows = df.collect()
    made, plans = [], [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif "QueryStage" in p.getClass().getSimpleName():
            plans.append(p.plan())
        if p.metrics().contains("numOutputRows"):
            made.append(p.metrics().apply("numOutputRows").value())
        plans += [p.children().apply(k) for k in range(p.children().size())]
    assert len(rows) == 2000 and 2000 <= max(made) < 20_000


def test_deliveries_keep_a_timer_for_each_bucket_and_not_for_each_key(spark, tmp_path):
    """3,000 keys over two micro-batches against the batch, and a null key, which is one like others on a stream; what comes after the judgement is judged by it."""
    from chronolane.operators import identity
    from chronolane.streaming import replay

    rng = random.Random(11)
    given = [(f"k{n % 3000}", rng.choice(["a", "b", None]), n, day(rng.randrange(5))) for n in range(8000)] + [(None, "a", 8000, day(1)), (None, "a", 8001, day(2))]
    rng.shuffle(given)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    src = str(tmp_path / "in")
    late = [(9000, day(2), None, "k5", None, "a"), (9001, day(2), None, "k5", None, "b"), (9003, day(400), None, "end", None, None)]
    parts = [[(s, t, None, k, None, c) for k, c, s, t in given[n : n + 4001]] for n in (0, 4001)] + [[(9002, day(19), None, "end", None, None)], late]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        run = replay.into(replay.settled(replay.read_quotes(spark, src), "event_type", "props", "ts", "event_id", 6), str(tmp_path / "settled"), str(tmp_path / "state"))
        run.awaitTermination()
        timers = [op["customMetrics"].get("numRegisteredTimers", 0) for p in run.recentProgress for op in p["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 0 < max(timers) <= replay.BUCKETS
    rows = spark.read.parquet(str(tmp_path / "settled")).where("not key <=> 'end'").collect()
    got = {r["seq"]: r["delivery"] for r in rows}
    batch = identity.deliveries(spark.createDataFrame([r[:3] for r in given], "key string, content string, seq long"), "key", "content", "seq")
    first = next(c for k, c, s, _ in sorted(given, key=lambda r: r[2]) if k == "k5")
    assert len(rows) == len(got) and got == {r["seq"]: r["delivery"] for r in batch.collect()} | {9000 + n: "DUPLICATE_NOOP" if c == first else "KEY_CONFLICT" for n, c in enumerate("ab")} | {8000: "ACCEPTED", 8001: "DUPLICATE_NOOP"}


def rounds(monkeypatch, module):
    """The names of the tables that an operator writes."""
    names, plain = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or plain(df, name))
    return names


def test_rows_on_a_cycle_do_not_ask_for_rounds_of_their_own(spark, monkeypatch):
    """Chains of 12 beside cycles of 1, 2, 3 and 7, rows behind them and 5,000 roots: rounds follow the chains, and no table goes through the driver."""
    from chronolane.operators import revisions

    names = rounds(monkeypatch, revisions)
    links = [(n, n - 1 if n % 12 else None) for n in range(120)] + [(1000 * c + i, 1000 * c + (i + 1) % c) for c in (1, 2, 3, 7) for i in range(c)] + [(1500, 1000), (1501, 1500), (7100, 7003), (9001, 9000), (9002, 9001)]
    rows = spark.createDataFrame(links + [(n, None) for n in range(20_000, 25_000)], "node long, parent long")
    got = revisions.chain_states(rows, [], "node", "parent")
    assert "Broadcast" not in got._jdf.queryExecution().toString() and len(names) <= 7
    found = {r["node"]: (r["chain"], r["depth"]) for r in got.collect()}
    assert found == {n: ("REACHED", n % 12) if n < 120 else ("REACHED", 0) if n >= 20_000 else ("DANGLING", None) if n > 9000 else ("CYCLE", None) for n, _ in links + [(n, None) for n in range(20_000, 25_000)]}


def test_ways_that_never_end_are_seen_when_none_ends(spark, monkeypatch):
    """As before, in a graph's levels."""
    from chronolane.operators import graphs

    names = rounds(monkeypatch, graphs)
    edges = [(n, n - 1) for n in range(120) if n % 12] + [(1000 * c + i, 1000 * c + (i + 1) % c) for c in (1, 2, 3, 7) for i in range(c)] + [(1500, 1000), (1501, 1500), (7100, 7003)]
    nodes = sorted({n for e in edges for n in e} | set(range(20_000, 25_000)))
    got = graphs.levels(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "node long, parent long"))
    assert {r["node"]: r["level"] for r in got.collect()} == {n: n % 12 if n < 120 else 0 if n >= 20_000 else None for n in nodes} and names.count("singles") <= 9


def test_an_append_stages_the_content_of_new_records_alone(spark, tmp_path, monkeypatch):
    """Repeats, conflicts, refused and stored records beside new ones; and a manifest's own hash is not joined."""
    from chronolane.sources import archive

    staged, plain = {}, archive.written
    monkeypatch.setattr(archive, "written", lambda df, name: staged.setdefault(name, []).append(plain(df, name)) or staged[name][-1])
    path = str(tmp_path / "archive")
    make = lambda *rows: spark.createDataFrame([(k, 1, "odds", "p", 1, day(0), day(1), body, None, domain) for k, body, domain in rows], archive.SCHEMA)
    archive.append(make(("a", "x", "PRE_MATCH"), ("b", "x", "PRE_MATCH")), path)
    report = archive.append(make(("a", "x", "PRE_MATCH"), ("b", "y", "PRE_MATCH"), ("c", "x", "PRE_MATCH"), ("c", "x", "PRE_MATCH"), ("d", "x", "PRE_MATCH"), ("d", "y", "PRE_MATCH"), ("e", "x", "ELSEWHERE")), path)
    assert sorted(map(tuple, report.collect())) == [("a", "NOOP"), ("b", "CONFLICT"), ("c", "APPENDED"), ("c", "APPENDED"), ("d", "APPENDED"), ("d", "CONFLICT"), ("e", "UNKNOWN_DOMAIN")]
    assert sorted(r["record_id"] for r in archive.verified_scan(spark, path).collect()) == ["a", "b", "c", "d"]
    assert sorted(r["record_id"] for r in staged["judged"][-1].where("payload is not null").collect()) == ["c", "d"]
    plan = archive.manifest_states(spark, path).select("manifest_state")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    assert "manifest_hash" not in plan.children().apply(0).output().toString()


def test_a_match_across_partitions_is_found_without_distinct_counts(spark):
    from chronolane.operators import validation

    rows = [(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "b", 2), (5, "c", None), (6, "c", 2), (7, "d", None)]
    s = spark.createDataFrame(rows, "id long, match string, part long").withColumns({c: F.lit(n) for n, c in enumerate(("at", "cut", "label"))})
    got = validation.leakage(s, "id", "at", "cut", "label", "part", "match")
    assert [tuple(r) for r in got.collect()] == [("MATCH_ACROSS_PARTITIONS", "b")] and "distinct" not in got._jdf.queryExecution().executedPlan().toString()

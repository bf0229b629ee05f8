"""Semantic traps of single operators, on rows small enough to check by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from chronolane.functions import arrays, canonical, times
from chronolane.operators import constraints, identity, intake, joins, market, metrics, plugins, quality, revisions, splits, stats, timing, validation


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("values,iqr", [([1, 2, 3, 4, 5, 6, 7], 4.0), ([5], 0.0), ([], 0.0), ([1, 9], 8.0), ([1, 2, 3], 2.0)])
def test_tukey_iqr_leaves_the_median_out(spark, values, iqr):
    assert one(spark, arrays.tukey_iqr(F.lit(values).cast("array<double>") if values else F.array().cast("array<double>"))) == iqr


def test_mad(spark):
    a = F.array(*map(F.lit, (1.0, 1.0, 2.0, 2.0, 4.0, 6.0, 9.0)))
    assert one(spark, arrays.sorted_median(a)) == 2.0 and one(spark, arrays.mad(a, F.lit(2.0))) == 1.0


@pytest.mark.parametrize("text,seconds", [("P1D", 86400), ("PT2H30M", 9000), ("P1DT1S", 86401), ("PT0S", None), ("1D", None), ("P", None), ("PT", None), ("P1DT", None), (None, None)])
def test_iso_duration(spark, text, seconds):
    assert one(spark, times.iso_duration_seconds(F.lit(text))) == seconds


def test_iso_instant_needs_an_offset(spark):
    assert one(spark, times.iso_instant(F.lit("2024-05-01T10:00:00.750+02:00"))) == dt.datetime(2024, 5, 1, 8)
    assert one(spark, times.iso_instant(F.lit("2024-05-01T10:00:00"))) is None


def test_asof_order_of_checks(spark):
    rows = [(day(1), day(2), day(3)), (day(2), day(2), day(3)), (day(2), day(1), day(3)), (day(3), day(1), day(3)), (day(0), day(3), day(3)), (None, day(1), day(2))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, c timestamp_ntz, k timestamp_ntz").select(timing.asof_state("a", "c", "k").alias("s"))
    assert [r["s"] for r in df.collect()] == ["AVAILABLE", "AVAILABLE", "FUTURE_DATA", "POSTMATCH_ONLY", "INVALID_BOUNDARY", "UNKNOWN_TIME"]


def test_visible_revision_keeps_post_match_rows(spark):
    rows = [("a", 1, "PRE_MATCH", day(1), 1), ("b", 1, "PRE_MATCH", day(5), 2), ("c", 2, "POST_MATCH", day(9), 1), ("d", 2, "POST_MATCH", day(8), 2)]
    df = spark.createDataFrame(rows, "record_id string, match long, domain string, available_at timestamp_ntz, revision int")
    got = {r["match"]: r["record_id"] for r in timing.visible(df, F.lit(day(3)).cast("timestamp_ntz"), ["match"]).collect()}
    assert got == {1: "a", 2: "d"}


def quotes(spark, rows):
    return spark.createDataFrame([(i, p, m, x, t, None) for i, (p, m, x, t) in enumerate(rows)], "quote_id long, provider long, market string, price double, source_time timestamp_ntz, line int")


def test_one_bad_pair_blocks_its_series(spark):
    q = quotes(spark, [(1, "m", 2.0, day(0)), (1, "m", 3.0, day(1)), (1, "m", 3.0, day(1)), (2, "m", 2.0, day(0)), (2, "m", 1.5, day(2)), (3, "m", None, day(0))])
    got = {r["quote_id"]: (r["state"], r["delta"], r["velocity"]) for r in market.movements(q).collect()}
    assert [got[i][0] for i in range(6)] == ["BLOCKED"] * 3 + ["FIRST", "AVAILABLE", "BLOCKED"]
    assert got[4][1] == -0.5 and got[4][2] == pytest.approx(-0.5 / 48)


def test_pressure_drops_zeros_and_sees_reversal(spark):
    q = quotes(spark, [(1, "m", x, day(i)) for i, x in enumerate([5.0, 6.0, 6.0, 7.0, 8.0, 7.0])])
    r = market.pressure_runs(market.movements(q)).first()
    assert (r["longest"], r["direction"], r["reversed"]) == (3, 1, True)


def test_acceleration_needs_three(spark):
    q = quotes(spark, [(1, "m", 1.0, day(0)), (1, "m", 2.0, day(1)), (2, "m", 1.0, day(0)), (2, "m", 2.0, day(1)), (2, "m", 4.0, day(2))])
    got = {r["provider"]: r for r in market.accelerations(market.movements(q)).collect()}
    assert got[1]["accel_state"] == "UNKNOWN" and got[2]["acceleration"] == pytest.approx((2 / 24 - 1 / 24) / 24)


def test_implied_probability_sums_to_one(spark):
    q = quotes(spark, [(1, "h", 2.0, day(0)), (1, "d", 4.0, day(0)), (1, "a", 4.0, day(0)), (1, "x", -1.0, day(0))])
    got = market.implied_probability(q, "provider").collect()
    assert sorted(r["implied"] for r in got) == [0.25, 0.25, 0.5]


def test_decay_ranks_distinct_matches(spark):
    rows = [(1, 10, 4.0, day(2)), (1, 10, 2.0, day(2)), (1, 11, 6.0, day(1)), (1, 12, None, day(0))]
    df = spark.createDataFrame(rows, "team long, match_id long, v double, event_time timestamp_ntz")
    r = stats.rating(df, "team", "v", half_life=1.0, least=2).first()
    assert r["rating"] == pytest.approx((4 + 2 + 6 * 0.5) / 2.5) and r["rows"] == 4 and r["matches"] == 3 and r["state"] == "AVAILABLE"
    assert stats.rating(df, "team", "v", least=5).first()["rating"] is None
    assert stats.recent(df, ["team"], 1).count() == 2


def test_identity_resolution_and_conflicts(spark):
    known = spark.createDataFrame([("b1", "s1", 1), ("b2", "s2", 2)], "bk string, sk string, identity_id long")
    rows = spark.createDataFrame([("b1", "s1"), ("b1", "s2"), (None, "s2"), ("b9", "s9")], "bk string, sk string")
    got = {(r["bk"], r["sk"]): (r["match_state"], r["resolved"]) for r in identity.resolve(rows, known, ["bk"], ["sk"]).collect()}
    assert got == {("b1", "s1"): ("BUSINESS_KEY", 1), ("b1", "s2"): ("CONFLICT", None), (None, "s2"): ("STRUCTURAL_KEY", 2), ("b9", "s9"): ("NEW", None)}


def test_duplicate_pairs_are_all_pairs(spark):
    """Against every pair by duplicate_class, with repeated rows and nulls, far more than ten ids apart."""
    values = [(float(i % 7) if i % 11 else None, "ab"[i % 2], i % 3, i * i % 5 if i % 13 else None) for i in range(60)]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id int, content double, source string, time int, key int")
    a, b = rows.alias("a"), rows.alias("b")
    parts = lambda side: {k: F.col(f"{side}.{k}") for k in ("content", "source", "time", "key")}
    want = a.join(b, F.col("a.id") < F.col("b.id")).groupBy(identity.duplicate_class(parts("a"), parts("b")).alias("relation")).count()
    got = identity.duplicate_pairs(rows.drop("id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(got.collect()) == 4 and identity.duplicate_pairs(rows.drop("id").limit(0)).count() == 0


def test_deliveries(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("k", "b", 3), ("z", None, 4), ("z", None, 5)], "key string, content string, seq long")
    got = [r["delivery"] for r in identity.deliveries(rows, "key", "content", "seq").orderBy("seq").collect()]
    assert got == ["ACCEPTED", "DUPLICATE_NOOP", "KEY_CONFLICT", "ACCEPTED", "DUPLICATE_NOOP"]


def test_chain_depth_stops_at_cycles(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (2, 7, 8), (2, 8, 7)], "k int, node int, parent int")
    got = {(r["k"], r["node"]): r["depth"] for r in revisions.chain_depth(rows, ["k"], "node", "parent").collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2}


def test_chain_depth_walks_to_the_end(spark):
    """Longer than any cap, beside a longer cycle, a row behind it, and a row that hangs on a missing parent."""
    chain = [(1, i, i - 1 if i else None) for i in range(700)]
    cycle = [(2, i, (i + 1) % 130) for i in range(130)] + [(2, 500, 0), (3, 5, 4), (3, 6, 5)]
    rows = spark.createDataFrame(chain + cycle, "k int, node int, parent int")
    got = sorted((r["k"], r["node"], r["depth"]) for r in revisions.chain_depth(rows, ["k"], "node", "parent").collect())
    assert got == [(1, i, i) for i in range(700)]
    states = revisions.chain_states(rows, ["k"], "node", "parent")
    assert {(r["k"], r["chain"]): r["count"] for r in states.groupBy("k", "chain").count().collect()} == {(1, "REACHED"): 700, (2, "CYCLE"): 131, (3, "DANGLING"): 2}
    assert revisions.resolved(states.where("k = 1"), strict=True).count() == 700
    assert revisions.resolved(states.where("k != 2")).where("chain = 'DANGLING'").count() == 2
    for bad, strict in (("k = 2", False), ("k = 3", True)):
        with pytest.raises(Exception, match="unresolvable chain"):
            revisions.resolved(states.where(bad), strict).collect()


def test_audit_entry_covers_what_it_follows(spark):
    rows = spark.createDataFrame([("e", 1, "a"), ("e", 2, "b")], "entity string, at int, body string")
    other = spark.createDataFrame([("e", 1, "x"), ("e", 2, "b")], "entity string, at int, body string")
    chain = lambda df: {r["at"]: (r["prev_hash"], r["entry_hash"]) for r in revisions.audit_chain(df, ["entity"], ["at"], "body").collect()}
    assert chain(rows)[2][1] != chain(other)[2][1] and chain(rows)[2][0] == chain(rows)[1][1] and chain(rows)[1][0] is None


def test_audit_chain_shows_a_change_in_all_later_entries(spark):
    rows = [(e, i, f"{e}{i}") for e in ("a", "b", None) for i in range(50)]
    df = lambda first: spark.createDataFrame([(e, i, first if (e, i) == ("a", 0) else b) for e, i, b in rows], "entity string, at int, body string").repartition(5)
    one, two = ({(r["entity"], r["at"]): r["entry_hash"] for r in revisions.audit_chain(df(x), ["entity"], ["at"], "body").collect()} for x in ("a0", "changed"))
    assert len(one) == 150 and {k for k in one if one[k] != two[k]} == {("a", i) for i in range(50)}


def test_hash_form_refuses_a_line_break(spark):
    good = "sha256:" + "a" * 64
    df = spark.createDataFrame([(good,), (good + "\n",), (good.upper(),)], "h string")
    assert [r["ok"] for r in df.select(validation.is_hash("h").alias("ok")).collect()] == [True, False, False]


def test_probability_vector(spark):
    rows = [([0.5, 0.5],), ([0.5, 0.6],), ([1.2, -0.2],), ([1.0],), ([float("nan"), 1.0],)]
    got = spark.createDataFrame(rows, "p array<double>").select(validation.probability_vector(F.col("p"), 2).alias("s")).collect()
    assert [r["s"] for r in got] == ["OK", "SUM", "RANGE", "LENGTH", "RANGE"]


def test_explicit_split_needs_one_interval(spark):
    rows = spark.createDataFrame([(1, day(0)), (1, day(1)), (2, day(1)), (2, day(5)), (3, day(2))], "m long, at timestamp_ntz")
    at = lambda n: F.lit(day(n)).cast("timestamp_ntz")
    got = {r["m"]: r["partition"] for r in splits.explicit_split(rows, "m", "at", [("train", at(0), at(2)), ("test", at(2), at(9))]).collect()}
    assert got == {1: "train", 2: "NONE", 3: "SEVERAL"}


def test_walk_forward_intervals(spark):
    rows = spark.createDataFrame([(n, day(n)) for n in range(0, 31, 10)], "m long, at timestamp_ntz")
    folds = splits.folds(spark, "2024-01-01", "2024-01-11", "2024-01-11", 30)
    got = {r["m"]: r["partition"] for r in splits.walk_forward(rows, folds, "m", "at", 10, 10).collect()}
    assert got == {0: "train", 10: "train", 20: "validation", 30: "holdout"}


def test_floor_thirds_is_not_ntile(spark):
    rows = spark.createDataFrame([(n,) for n in range(5)], "n long")
    got = [r["partition"] for r in splits.floor_thirds(rows.withColumn("g", F.lit(1)), ["g"], "n").orderBy("n").collect()]
    assert got == ["train", "validation", "validation", "test", "test"]


def test_metrics(spark):
    rows = spark.createDataFrame([([0.5, 0.5], 0), ([0.0, 1.0], 0)], "p array<double>, y int")
    r = rows.agg(metrics.log_loss(F.col("p"), F.col("y")).alias("l"), metrics.brier(F.col("p"), F.col("y")).alias("b")).first()
    assert r["l"] == pytest.approx((math.log(2) - math.log(1e-15)) / 2) and r["b"] == pytest.approx((0.5 + 2) / 2)
    assert [x["k"] for x in rows.select(metrics.argmax(F.col("p")).alias("k")).collect()] == [0, 1]
    top = one(spark, metrics.top_two(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25)), ["home", "draw", "away"]))
    assert [(t["name"], t["confidence"]) for t in top] == [("draw", 0.75), ("away", 0.625)]
    r = metrics.recalls(rows.withColumn("k", metrics.argmax(F.col("p"))), [], "y", "k", 2).first()
    assert (r["recall_0"], r["recall_1"], r["macro"]) == (0.5, None, 0.5)


def test_standardise_uses_training_rows_and_population_deviation(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("a", 5.0, False), ("b", 7.0, True)], "g string, v double, train boolean")
    got = {r["v"]: r["z"] for r in metrics.standardised(rows, ["g"], "v", F.col("train")).collect()}
    assert got == {1.0: -1.0, 3.0: 1.0, 5.0: 3.0, 7.0: 0.0}


def test_encoder_unknown_is_zero(spark):
    rows = spark.createDataFrame([("b", True), ("a", True), ("c", False), (None, True)], "c string, train boolean")
    assert {r["c"]: r["code"] for r in metrics.encoded(rows, "c", F.col("train")).collect()} == {"a": 1, "b": 2, "c": 0, None: 0}


def test_claims_stay_resolved(spark):
    items = spark.createDataFrame([("x", "1", False), ("x", "2", False), ("y", "1", True), ("z", "1", False)], "claim string, content string, bad boolean")
    got = {r["claim"]: r["claim_state"] for r in quality.claims(items, "claim", "content", F.col("bad"), items.where("claim = 'y'")).collect()}
    assert got == {"x": "CONFLICTED", "y": "RESOLVED", "z": "CONSISTENT"}


def test_joins_keep_rejects(spark):
    rows, known = spark.createDataFrame([(1,), (2,), (3,)], "k long"), spark.createDataFrame([(1, "RESOLVED"), (2, "OPEN")], "k long, s string")
    assert {r["k"]: r["reject"] for r in joins.lookup(rows, known, ["k"], "s").collect()} == {1: None, 2: "IDENTITY_UNRESOLVED", 3: "IDENTITY_MISSING"}


def test_registry_guard(spark):
    old = spark.createDataFrame([(1, "a", "n", 5)], "k int, fixed string, note string, stamp int")
    for row, state in (((1, "a", "m", 6), "OK"), ((1, "b", "n", 6), "FROZEN_COLUMN"), ((1, "a", "n", 4), "STAMP_BACKWARDS"), ((2, "a", "n", 6), "UNKNOWN_ROW")):
        new = spark.createDataFrame([row], "k int, fixed string, note string, stamp int")
        assert constraints.guarded_update(old, new, "k", ["note"], "stamp").first()["update_state"] == state


def test_layout_needs_equal_length(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, intake.layout_match(a(1.0, 9.0), a(10.0, 2.0), 1.0)) is True
    assert one(spark, intake.layout_match(a(1.0), a(10.0, 2.0), 1.0)) is False


def test_canonical_text(spark):
    df = spark.createDataFrame([("ﬁ Straße-X", '{"b": 1.50, "a": [1, {"secret": null}]}'), (None, "{"), ("", '{"a": NaN}')], "t string, j string")
    got = df.select(canonical.alias_key("t").alias("k"), canonical.normal_text("t").alias("n"), canonical.canonical_json("j").alias("c")).collect()
    assert got[0]["k"] == "fistrassex" and got[0]["n"] == "fi Straße-X" and got[0]["c"] == '{"a":[1,{"secret":null}],"b":1.5}'
    assert (got[1]["k"], got[1]["c"], got[2]["n"], got[2]["c"]) == (None, None, None, None)
    assert df.limit(1).select(canonical.forbidden_path(("secret",))("j").alias("p")).first()["p"] == "$.a[1].secret"
    assert df.limit(1).select(canonical.without_keys(("a",))("j").alias("p")).first()["p"] == '{"b":1.5}'
    bad = spark.createDataFrame([("{",), ("[1]",), (None,), ("[" * 100_000,)], "j string")
    assert [(r["a"], r["b"]) for r in bad.select(canonical.without_keys(("a",))("j").alias("a"), canonical.forbidden_path(("x",))("j").alias("b")).collect()] == [(None, None)] * 4


def test_name_uuid_is_version_5(spark):
    import uuid

    names = ["", "abc", "ü 中文", "x" * 1000] + [f"n{i}" for i in range(40)]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string")
    assert [r["u"] for r in df.select(canonical.name_uuid("n").alias("u")).collect()] == [*(str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names), None]


def test_user_functions(spark):
    rows = spark.createDataFrame([(1, 0.25), (2, 2.0)], "id long, x double")
    got = plugins.predict(rows, lambda b: [[x, 1 - x] for x in b["x"]], ["id"], 2).orderBy("id").collect()
    assert [r["check"] for r in got] == ["OK", "RANGE"]
    means = plugins.fit_by(rows.withColumn("g", F.lit("a")), ["g"], lambda p: p.groupby("g", as_index=False).agg(mean=("x", "mean")), "g string, mean double", 100)
    assert means.first()["mean"] == 1.125


def test_pieces_equal_whole_windows(spark):
    from pyspark.sql import Window

    from chronolane.operators import series

    rows = [(k, day(n % 40 // 4) + dt.timedelta(hours=n % 3), n, None if n % 7 == 0 else float(n * n % 11)) for k in ("a", "b", None) for n in range(60)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id long, v double")
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumn("before", F.lag("v").over(w)).withColumn("total", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = series.lagged(df, ["k"], "t", "id", {"before": "v"}, series.daily("t"))
    got = series.running_sum(got.withColumn("v", F.coalesce("v", F.lit(0.0))), ["k"], "t", "id", "v", "total", series.daily("t"))
    key = lambda r: (str(r["k"]), r["id"], r["before"], r["total"] or 0.0)
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want.collect()), key=str)


def test_public_projection_reads_whole_texts(spark, tmp_path):
    from chronolane import catalog

    texts = ["a" * 300, "a" * 300 + " my PassWord", "token first", "b" * 198 + "secret"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 1) for i in range(4)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r["doc_id"] for r in catalog.queries()["public_projection"](spark, str(tmp_path)).collect()] == [0]

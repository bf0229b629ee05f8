"""Archive, lines, pictures and streams."""

import datetime as dt
import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolane.sources import archive, images, lines
from chronolane.streaming import replay


def at(n):
    return dt.datetime(2024, 1, n)


def records(spark, rows):
    return spark.createDataFrame([(*r, None, d) for *r, d in rows], archive.SCHEMA)


def test_archive_appends_once_and_reads_as_of(spark, tmp_path):
    path = str(tmp_path / "archive")
    assert archive.scan(spark, path).count() == 0
    rows = [
        ("a", 1, "odds", "P1", 1, at(1), at(9), "x", "PRE_MATCH"), ("b", 1, "odds", "P1", 2, at(5), at(9), "y", "PRE_MATCH"), ("c", 1, "result", "P1", 1, at(10), at(9), "z", "POST_MATCH"),
        ("d", 2, "odds", "P1", 1, at(9), at(9), "late", "PRE_MATCH"), ("e", 2, "result", "P1", 1, at(8), at(9), "early", "POST_MATCH"), ("f", 2, "odds", "P1", 1, at(1), at(9), "q", "OTHER"),
    ]
    report = {r["record_id"]: r["outcome"] for r in archive.append(records(spark, rows), path).collect()}
    assert report == {"a": "APPENDED", "b": "APPENDED", "c": "APPENDED", "d": "POSTMATCH_ONLY", "e": "LABEL_BEFORE_KICKOFF", "f": "UNKNOWN_DOMAIN"}
    again = [rows[0], ("b", 1, "odds", "P1", 2, at(5), at(9), "changed", "PRE_MATCH"), ("g", 3, "odds", "P1", 1, at(1), at(9), "n", "PRE_MATCH")]
    second = archive.append(records(spark, again), path)
    assert {r["record_id"]: r["outcome"] for r in second.collect()} == {"a": "NOOP", "b": "CONFLICT", "g": "APPENDED"}
    stored = archive.scan(spark, path)
    assert sorted(r["record_id"] for r in stored.collect()) == ["a", "b", "c", "g"]
    seen = archive.find(stored, F.lit(at(3)).cast("timestamp_ntz"), match_id=1, domain=None)
    assert sorted(r["record_id"] for r in seen.collect()) == ["a", "c"]
    with pytest.raises(ValueError):
        archive.find(stored, domain="ELSEWHERE")
    state = archive.capture_state(second.withColumn("session", F.lit("s")), ["session"]).first()
    assert (state["accepted"], state["refused"], state["state"]) == (2, 1, "PARTIAL")


def test_lines_and_ledger(spark, tmp_path):
    path = tmp_path / "ledger"
    path.mkdir()
    good = {"body": "x", "body_hash": "sha256:" + hashlib.sha256(b"x").hexdigest()}
    (path / "a.jsonl").write_text("\n".join([json.dumps(good), json.dumps({"body": "y", "body_hash": "sha256:0"}), "{broken"]) + "\n")
    got = lines.ledger(spark, str(path), "body string, body_hash string").collect()
    assert sorted((r["body"] or "", r["sound"], r["_corrupt"] is not None) for r in got) == [("", False, True), ("x", True, False), ("y", False, False)]
    lines.write_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert [tuple(r)[:2] for r in lines.read_lines(spark, str(tmp_path / "out"), "a int, b string").collect()] == [(1, None)]


def png(pixels: np.ndarray, filters: list[int]) -> bytes:
    h, w, n = pixels.shape
    colour = {v: k for k, v in images.CHANNELS.items()}[n]
    raw, above = b"", np.zeros(w * n, np.uint8)
    for y in range(h):
        row = pixels[y].ravel()
        left = np.concatenate((np.zeros(n, np.uint8), row[:-n])).astype(int)
        corner = np.concatenate((np.zeros(n, np.uint8), above[:-n])).astype(int)
        up = above.astype(int)
        p = left + up - corner
        near = np.stack((abs(p - left), abs(p - up), abs(p - corner))).argmin(axis=0)
        guess = {0: 0 * up, 1: left, 2: up, 3: (left + up) // 2, 4: np.choose(near, (left, up, corner))}[filters[y]]
        raw += bytes([filters[y]]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png(spark, tmp_path):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4):
        pixels = rng.integers(0, 256, (5, 7, n), dtype=np.uint8)
        want = pixels[..., 0] if n < 3 else pixels[..., :3] @ images.WEIGHTS
        assert np.allclose(images.luminance(png(pixels, [0, 1, 2, 3, 4])), want)
    (tmp_path / "a.png").write_bytes(png(np.zeros((2, 3, 1), np.uint8), [0, 2]))
    (tmp_path / "b.png").write_bytes(b"nothing")
    got = sorted((r["path"][-5:], r["width"], r["height"], r["dark"]) for r in images.read_pictures(spark, str(tmp_path)).collect())
    assert got == [("a.png", 3, 2, 1.0), ("b.png", None, None, None)]


def test_streams(spark, tmp_path):
    rows = [(1, at(1), 1, "a", 1.0, "{}"), (1, at(1), 1, "a", 1.0, "{}"), (2, at(2), 1, "a", 2.0, "{}"), (2, at(2), 1, "a", 3.0, "{}")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(src)
    stream = replay.once(replay.read_quotes(spark, src), ["event_id"], "ts")
    replay.into(stream, str(tmp_path / "once"), str(tmp_path / "c1")).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "once")).collect()) == [1, 2]
    replay.into(replay.judged(replay.read_quotes(spark, src), "event_id", "value", "ts", "user_id"), str(tmp_path / "judged"), str(tmp_path / "c2")).awaitTermination()
    got = sorted(r["delivery"] for r in spark.read.parquet(str(tmp_path / "judged")).collect())
    assert got == ["ACCEPTED", "ACCEPTED", "DUPLICATE_NOOP", "KEY_CONFLICT"]
    # as a batch judges them: by seq, null contents equal, over several micro-batches
    given = [("k", "b", 2), ("k", None, 1), ("k", None, 3), (None, "x", 4), ("z", "q", 5), ("z", "q", 6), (None, "y", 7)]
    for n, part in enumerate((given[:3], given[3:5], given[5:])):
        spark.createDataFrame([(i, at(n + 1), None, k, None, v) for k, v, i in part], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in2"))
    replay.into(replay.judged(replay.read_quotes(spark, str(tmp_path / "in2")), "event_type", "props", "ts", "event_id", 9), str(tmp_path / "judged2"), str(tmp_path / "c4")).awaitTermination()
    got = {r["seq"]: r["delivery"] for r in spark.read.parquet(str(tmp_path / "judged2")).collect()}
    from chronolane.operators import identity

    batch = identity.deliveries(spark.createDataFrame(given, "key string, content string, seq long").where("key is not null"), "key", "content", "seq")
    assert {k: v for k, v in got.items() if k not in (4, 7)} == {r["seq"]: r["delivery"] for r in batch.collect()} and (got[4], got[7]) == ("ACCEPTED", "KEY_CONFLICT")
    gated = replay.gated(replay.read_quotes(spark, src).withColumn("cutoff", F.lit(at(1)).cast("timestamp_ntz")).withColumn("kickoff", F.lit(at(5)).cast("timestamp_ntz")), "ts", "cutoff", "kickoff")
    replay.into(gated, str(tmp_path / "gated"), str(tmp_path / "c3")).awaitTermination()
    assert sorted(r["gate_state"] for r in spark.read.parquet(str(tmp_path / "gated")).collect()) == ["AVAILABLE"] * 2 + ["FUTURE_DATA"] * 2


def test_jdbc_table(spark, tmp_path):
    """An embedded database of Spark's own jars, read whole and in ranges."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    given = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "id long, name string")
    given.coalesce(1).write.format("jdbc").options(url=url, dbtable="known", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    assert lines.read_table(spark, url, "known", **driver).count() == 50
    ranged = lines.read_table(spark, url, "known", "id", (0, 50), 4, **driver)
    assert ranged.rdd.getNumPartitions() == 4 and sorted(r[0] for r in ranged.collect()) == list(range(50))


def test_section_bars_of_a_picture(spark, tmp_path):
    from chronolane.operators import intake

    pixels = np.full((60, 20, 1), 255, np.uint8)
    pixels[5:17] = 0
    pixels[30:36] = 0
    pixels[45:60, 2:] = 10
    (tmp_path / "a.png").write_bytes(png(pixels, [0] * 60))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    bars = intake.bar_spans(images.read_lines_of(spark, str(tmp_path)), "path", "y", "dark")
    assert sorted((r["start"], r["end"]) for r in bars.collect()) == [(5, 17), (45, 60)]


def test_a_small_append_reads_its_own_buckets(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = [(f"r{k}", k, "odds", "p", 1, at(1), at(5), "x", "PRE_MATCH") for k in range(300)]
    archive.append(records(spark, rows), path)
    batch = records(spark, [("r7", 7, "odds", "p", 1, at(1), at(5), "x", "PRE_MATCH"), ("r8", 8, "odds", "p", 1, at(1), at(5), "y", "PRE_MATCH"), ("new", 9, "odds", "p", 1, at(1), at(5), "x", "PRE_MATCH")])
    own = sorted({r["b"] for r in batch.select(archive.bucket().alias("b")).collect()})
    plan = archive.stored(spark, path, own)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]
    assert archive.stored(spark, path, own).select(F.input_file_name()).distinct().count() == len(own) < archive.BUCKETS
    report = {r["record_id"]: r["outcome"] for r in archive.append(batch, path).collect()}
    assert report == {"r7": "NOOP", "r8": "CONFLICT", "new": "APPENDED"}
    assert archive.scan(spark, path).count() == archive.verified_scan(spark, path).count() == 301


def test_an_archive_is_read_by_its_manifests(spark, tmp_path):
    path = str(tmp_path / "archive")
    assert archive.verified_scan(spark, path).count() == 0
    archive.append(records(spark, [(f"r{k}", k, "odds", "p", 1, at(1), at(5), "x", "PRE_MATCH") for k in range(4)]), path)
    # an append that broke off before its manifest leaves records that are none of the archive's
    stray = records(spark, [("stray", 9, "odds", "p", 1, at(1), at(5), "x", "PRE_MATCH")]).withColumns({"content_hash": archive.content_hash(), "bucket": F.lit(0)})
    stray.write.partitionBy("domain", "bucket").parquet(f"{path}/append=broken")
    assert archive.scan(spark, path).count() == 5 and archive.verified_scan(spark, path).count() == 4
    known = {r["record_id"]: r for r in archive.manifests(spark, path).collect()}
    torn = {"r0": ("append=none", known["r0"]["artifact_hash"]), "r1": (known["r1"]["artifact_ref"], "sha256:0"), "gone": ("append=none", "sha256:0")}
    rows = spark.createDataFrame([(k, *v) for k, v in torn.items()], "record_id string, ref string, stated string")
    archive.manifest_rows(rows, F.col("ref"), "stated").write.parquet(f"{archive.manifests_path(path)}/append=torn")
    spark.createDataFrame([("r2", known["r2"]["artifact_ref"], known["r2"]["artifact_hash"], "sha256:0")], "record_id string, artifact_ref string, artifact_hash string, manifest_hash string").write.parquet(f"{archive.manifests_path(path)}/append=forged")
    states = sorted((r["record_id"], r["manifest_state"]) for r in archive.manifest_states(spark, path).collect())
    assert states == [("gone", "RECORD_MISSING"), ("r0", "OK"), ("r0", "RECORD_ELSEWHERE"), ("r1", "ARTIFACT_HASH_MISMATCH"), ("r1", "OK"), ("r2", "MANIFEST_HASH_MISMATCH"), ("r2", "OK"), ("r3", "OK")]
    with pytest.raises(Exception, match="archive: "):
        archive.verified_scan(spark, path).collect()


def test_deliveries_settle_in_any_order(spark, tmp_path):
    """Rows of several keys, dealt at random over micro-batches, against the batch; rows without time and late ones have a state too."""
    import random

    from chronolane.operators import identity

    rng = random.Random(5)
    given = [(f"k{rng.randrange(6)}", rng.choice(["a", "b", None]), seq, at(1 + seq // 10)) for seq in range(60)]
    order = sorted(given, key=lambda r: r[2] + rng.randrange(25))  # at most some days late
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    src = str(tmp_path / "in")
    for n in range(0, 60, 15):
        spark.createDataFrame([(s, t, None, k, None, c) for k, c, s, t in order[n : n + 15]], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(100, None, None, "k1", None, "a"), (101, dt.datetime(2024, 6, 1), None, "end", None, None)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = replay.settled(replay.read_quotes(spark, src), "event_type", "props", "ts", "event_id", 4)
    replay.into(stream, str(tmp_path / "settled"), str(tmp_path / "state")).awaitTermination()
    got = {r["seq"]: r["delivery"] for r in spark.read.parquet(str(tmp_path / "settled")).collect()}
    batch = identity.deliveries(spark.createDataFrame([r[:3] for r in given], "key string, content string, seq long"), "key", "content", "seq")
    want = {r["seq"]: r["delivery"] for r in batch.collect()} | {100: "NO_EVENT_TIME"}
    assert {k: v for k, v in got.items() if k != 101} == want


def test_bars_by_colour_and_unreadable_pictures(spark, tmp_path):
    from chronolane.operators import intake

    pixels = np.full((40, 500, 3), 255, np.uint8)
    pixels[4:16] = (10, 60, 140)  # a bar
    pixels[4:16, :15] = 255  # nothing counts outside the columns
    pixels[20:32] = (10, 60, 150)  # too blue
    pixels[33:40] = (60, 10, 20)  # falls from red to green
    (tmp_path / "a.png").write_bytes(png(pixels, [0] * 40))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    shares = images.read_bars_of(spark, str(tmp_path))
    assert [(r["path"][-7:], r["y"], r["dark"]) for r in shares.where("y is null").collect()] == [("bad.png", None, None)]
    assert [(r["path"][-5:], r["start"], r["end"]) for r in intake.bar_spans(shares, "path", "y", "dark").collect()] == [("a.png", 4, 16)]
    got = {r["path"][-5:]: r["width"] for r in images.read_pictures(spark, str(tmp_path)).collect()}
    assert got == {"a.png": 500, "d.png": None}

"""Archive, lines, catalog, streams and user functions, run on the driver tables.

What these queries write goes to a folder of its own below the checkpoint folder that all executors share.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import days_between
from ..operators import plugins
from ..sources import archive, lines
from ..sources.driver_tables import table
from ..storage import fresh, written
from ..streaming import replay
from .registry import query


def records(orders: DataFrame, payload, domain) -> DataFrame:
    """Orders as archive records: available on their date, kickoff two days later, or before for the dearest."""
    day = lambda n: F.col("o_orderdate") + F.make_dt_interval(F.lit(n))
    kickoff = F.when(F.col("o_totalprice") > 450000, day(-1)).otherwise(day(2))
    out = orders.select(
        F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_custkey").alias("match_id"), F.lit("odds").alias("artifact_type"), F.col("o_orderpriority").alias("cutoff_profile"),
        F.year("o_orderdate").alias("revision"), F.col("o_orderdate").alias("available_at"), kickoff.alias("kickoff_at"), payload.cast("string").alias("payload"), F.lit(None).cast("string").alias("content_hash"), domain.alias("domain"),
    )
    return orders.sparkSession.createDataFrame([], archive.SCHEMA).unionByName(out)


def archived(spark, sf_dir) -> tuple[str, DataFrame]:
    """Two batches of orders in a new archive: final ones first, then all of them, those of low priority with other content."""
    path, o = fresh(spark, "archive"), table(spark, sf_dir, "orders")
    domain = F.when(F.col("o_totalprice") < 5000, "ELSEWHERE").otherwise("PRE_MATCH")
    archive.append(records(o.where("o_orderstatus = 'F'"), F.lit("x"), domain), path)
    return path, archive.append(records(o, F.when(F.col("o_orderpriority") == "5-LOW", "y").otherwise("x"), domain), path)


KNOWN = "case when o_totalprice < 5000 then 'UNKNOWN_DOMAIN' when o_totalprice > 450000 then 'POSTMATCH_ONLY' end"


@query(f"""select coalesce({KNOWN}, case when o_orderstatus != 'F' then 'APPENDED' when o_orderpriority = '5-LOW' then 'CONFLICT' else 'NOOP' end) as outcome, count(*) as n from orders group by 1""")
def archive_appends(spark, sf_dir):
    """Appending is idempotent: new records are added, equal ones are no-ops, others conflicts; unsound ones keep their reason."""
    return archived(spark, sf_dir)[1].groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""with r as (select * from orders where {KNOWN} is null and o_orderdate <= timestamp '1999-01-01') select o_custkey as match_id, o_orderpriority as cutoff_profile, max(year(o_orderdate))::int as revision, arg_max(cast(o_orderkey as varchar), row(year(o_orderdate), cast(o_orderkey as varchar))) as record_id from r group by all""")
def archive_as_of(spark, sf_dir):
    """The archive's records as they were visible at a cutoff."""
    stored = archive.verified_scan(spark, archived(spark, sf_dir)[0])
    seen = archive.find(stored, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"), domain="PRE_MATCH", artifact_type="odds")
    return seen.select("match_id", "cutoff_profile", "revision", "record_id")


@query(f"""select o_orderkey::varchar as record_id, o_orderdate as available_at from orders where {KNOWN} is null and o_custkey = 7""")
def archive_by_match(spark, sf_dir):
    """A point lookup, pushed into the archive's scan."""
    return archive.find(archive.scan(spark, archived(spark, sf_dir)[0]), match_id=7).select("record_id", "available_at")


@query(f"""with m as (select o_orderkey, {KNOWN} is null as stored, o_orderpriority as p from orders),
s as (select case when p = '2-HIGH' and stored then 'MANIFEST_HASH_MISMATCH' when not stored then 'RECORD_MISSING' when p = '3-MEDIUM' then 'RECORD_ELSEWHERE' when p = '4-NOT SPECIFIED' then 'ARTIFACT_HASH_MISMATCH' else 'OK' end as manifest_state, count(*) as n from m where p != '1-URGENT' or not stored group by 1
union all select 'OK', count(*) from m where stored) select manifest_state, cast(sum(n) as bigint) as n from s group by 1""")
def archive_manifests(spark, sf_dir):
    """The archive's manifests, all sound, beside further ones that state a wrong hash, file or record."""
    path, o = archived(spark, sf_dir)[0], table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderpriority").alias("p"))
    known = o.join(archive.manifests(spark, path), "record_id", "left").where("p != '1-URGENT' or artifact_ref is null")
    ref = F.when(F.col("p") == "3-MEDIUM", F.lit("append=none")).otherwise(F.coalesce("artifact_ref", F.lit("append=none")))
    stated = F.when(F.col("p") == "4-NOT SPECIFIED", F.lit("sha256:0")).otherwise(F.coalesce("artifact_hash", F.lit("sha256:0")))
    wrong = archive.manifest_rows(known, ref, stated).join(o, "record_id")
    # a stored record of high priority gets a manifest whose own hash is wrong
    torn = wrong.join(archive.scan(spark, path).select("record_id", F.lit(True).alias("there")), "record_id", "left").withColumn("manifest_hash", F.when((F.col("p") == "2-HIGH") & F.col("there"), "sha256:0").otherwise(F.col("manifest_hash")))
    written(torn.drop("p", "there"), "torn").write.parquet(f"{archive.manifests_path(path)}/append=torn")
    return archive.manifest_states(spark, path).groupBy("manifest_state").agg(F.count("*").alias("n"))


@query("""select case when o_totalprice > 450000 then 'APPENDED' else 'LABEL_BEFORE_KICKOFF' end as outcome, count(*) as n from orders group by 1""")
def archive_labels(spark, sf_dir):
    """Labels must not be known before kickoff."""
    path = fresh(spark, "labels")
    return archive.append(records(table(spark, sf_dir, "orders"), F.lit("label"), F.lit("POST_MATCH")), path).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""with r as (select o_custkey % 50 as session, coalesce({KNOWN}, 'APPENDED') as outcome from orders) select session, count(*) filter (outcome = 'APPENDED') as accepted, count(*) filter (outcome != 'APPENDED') as refused,
case when count(*) filter (outcome != 'APPENDED') = 0 then 'CAPTURED' when count(*) filter (outcome = 'APPENDED') > 0 then 'PARTIAL' else 'BLOCKED' end as state from r group by 1""")
def capture_sessions(spark, sf_dir):
    """A capture session by what it got into the archive."""
    o, path = table(spark, sf_dir, "orders"), fresh(spark, "capture")
    domain = F.when(F.col("o_totalprice") < 5000, "ELSEWHERE").otherwise("PRE_MATCH")
    report = archive.append(records(o, F.lit("x"), domain), path)
    sessions = o.select(F.col("o_orderkey").cast("string").alias("record_id"), (F.col("o_custkey") % 50).alias("session"))
    return archive.capture_state(report.join(sessions, "record_id"), ["session"])


@query("select event_id, event_type as kind, value from events")
def line_files(spark, sf_dir):
    """Events through JSON lines and back, by a declared schema."""
    path = fresh(spark, "lines")
    lines.write_lines(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "value"), path)
    return lines.read_lines(spark, path, "event_id long, kind string, value double").where("_corrupt is null").drop("_corrupt")


@query("select case when toxic = 1 then false else true end as sound, count(*) as n from documents d left join labels l on d.doc_id = l.doc_id where text is not null group by 1")
def review_ledger(spark, sf_dir):
    """Ledger lines whose stated hash must be that of their body."""
    path = fresh(spark, "ledger")
    d = table(spark, sf_dir, "documents").where("text is not null").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    stated = F.when(F.col("toxic") == 1, "sha256:0").otherwise(F.concat(F.lit("sha256:"), F.sha2("text", 256)))
    lines.write_lines(d.select(F.col("text").alias("body"), stated.alias("body_hash")), path)
    return lines.ledger(spark, path, "body string, body_hash string").groupBy("sound").agg(F.count("*").alias("n"))


@query("""select unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) as "column", unnest(['bigint', 'timestamp_ntz', 'bigint', 'string', 'double', 'string']) as "type", true as nullable""")
def catalog_scan(spark, sf_dir):
    """The catalog's columns of a view over the events."""
    name = f"scanned_{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").createTempView(name)
    found = lines.catalog_columns(spark).where(F.col("table") == name).drop("table")
    spark.catalog.dropTempView(name)
    return found


def streamed(spark, stream: DataFrame, name: str) -> DataFrame:
    """What a stream of all that is there now appends to a table of its own."""
    path = fresh(spark, name)
    replay.into(stream, path, f"{path}-state").awaitTermination()
    return spark.read.parquet(path)


def quotes(spark, sf_dir) -> DataFrame:
    """The events as a stream: copied once into a folder, as a stream reads folders."""
    path = fresh(spark, "arriving")
    table(spark, sf_dir, "events").write.parquet(path)
    return replay.read_quotes(spark, path, 1000)


@query("""select case when ts >= timestamp '2024-01-25' then 'POSTMATCH_ONLY' when ts > timestamp '2024-01-15' then 'FUTURE_DATA' else 'AVAILABLE' end as state, count(*) as n from events group by 1""")
def stream_gate(spark, sf_dir):
    """The as-of gate on a stream."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    q = quotes(spark, sf_dir).withColumns({"cutoff": at("2024-01-15 00:00:00"), "kickoff": at("2024-01-25 00:00:00")})
    return streamed(spark, replay.gated(q, "ts", "cutoff", "kickoff"), "gated").groupBy(F.col("gate_state").alias("state")).agg(F.count("*").alias("n"))


@query("select distinct user_id, event_type from events")
def stream_once(spark, sf_dir):
    """First deliveries on a stream; the horizon covers the whole table."""
    return streamed(spark, replay.once(quotes(spark, sf_dir), ["user_id", "event_type"], "ts", "60 days"), "once").select("user_id", "event_type")


@query("""with k as (select user_id || ':' || event_type as key, cast(cast(floor(value / 100) as bigint) as varchar) as content, event_id from events), f as (select key, min(event_id) as s, arg_min(content, event_id) as c from k group by key)
select event_id as seq, case when event_id = s then 'ACCEPTED' when content is not distinct from c then 'DUPLICATE_NOOP' else 'KEY_CONFLICT' end as delivery from k join f on k.key = f.key""")
def stream_deliveries(spark, sf_dir):
    """Deliveries judged on a stream that arrives in any order over several micro-batches, as a batch judges them."""
    path, e = fresh(spark, "deliveries"), table(spark, sf_dir, "events")
    e.repartition(5, F.hash("props", "event_id")).write.parquet(path)
    # a last row, long after all others, lets the watermark pass them
    e.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("event_id"), (F.col("ts") + F.make_dt_interval(F.lit(365))).alias("ts"), F.lit(None).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props")).write.mode("append").parquet(path)
    q = replay.read_quotes(spark, path, 1).withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type")).withColumn("content", F.floor(F.col("value") / 100).cast("string"))
    return streamed(spark, replay.settled(q, "key", "content", "ts", "event_id", 60), "settled").where("key != 'end'").select("seq", "delivery")


@query("""select event_id, round(value / 500, 6) as first, round(1 - value / 500, 6) as second, case when value > 500 then 'RANGE' else 'OK' end as "check" from events""")
def predictor(spark, sf_dir):
    """A user's function of a batch of rows, checked on the way out."""

    def two_way(batch: pd.DataFrame) -> list:
        return [[x / 500, 1 - x / 500] for x in batch["value"]]

    p = plugins.predict(table(spark, sf_dir, "events").select("event_id", "value"), two_way, ["event_id"], 2)
    return p.select("event_id", *(F.round(F.col("probabilities")[i], 6).alias(n) for i, n in enumerate(("first", "second"))), "check")


@query("select event_type as role, round(avg(value), 6) as mean, count(value) as n from events group by 1")
def fitted_by_role(spark, sf_dir):
    """A user's fit for each role, on all of its rows: sums of parts."""
    e = table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("role"), "value")
    f = plugins.fit_parts(e, ["role"], lambda rows, _: (len(rows), rows["value"].sum()), 2, lambda s, _: {"mean": s[1] / s[0], "n": int(s[0])}, "mean double, n long")
    return f.withColumn("mean", F.round("mean", 6))


@query("""select event_type as role, round(regr_slope(value, x), 5) as slope, round(regr_intercept(value, x), 5) as intercept from (select event_type, value, (epoch_us(ts) - epoch_us(timestamp '2024-01-15')) / 86400e6 as x from events) group by 1""")
def fitted_lines(spark, sf_dir):
    """A line through each role's values in time, from sums of parts."""

    def partial(rows: pd.DataFrame, _) -> list:
        x, y = rows["x"], rows["value"]
        return [len(rows), x.sum(), y.sum(), (x * x).sum(), (x * y).sum()]

    def finish(s, _) -> dict:
        slope = (s[0] * s[4] - s[1] * s[2]) / (s[0] * s[3] - s[1] * s[1])
        return {"slope": slope, "intercept": (s[2] - slope * s[1]) / s[0]}

    middle = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").where("value is not null and ts is not null").select(F.col("event_type").alias("role"), "value", days_between(middle, "ts").alias("x"))
    f = plugins.fit_parts(e, ["role"], partial, 5, finish, "slope double, intercept double")
    return f.select("role", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))

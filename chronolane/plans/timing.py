"""As-of queries on orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import iso_duration_seconds, stage_cutoff
from ..operators import timing as t
from ..sources.driver_tables import matches, observations, quotes, table
from .registry import query

JOINED = "lineitem l join orders o on l.l_orderkey = o.o_orderkey"
STATE = """case when l_shipdate is null or o_orderdate is null then 'UNKNOWN_TIME' when l_shipdate >= o_orderdate + interval 60 day then 'POSTMATCH_ONLY'
when l_shipdate > o_orderdate + interval 30 day then 'FUTURE_DATA' else 'AVAILABLE' end"""


def gated(spark, sf_dir):
    """Observations of matches with a cutoff 30 and a kickoff 60 days after the order."""
    both = observations(spark, sf_dir).join(matches(spark, sf_dir).select("match_id", "event_time", "status"), "match_id")
    day = F.make_dt_interval
    return both.withColumn("cutoff", F.col("event_time") + day(F.lit(30))).withColumn("kickoff", F.col("event_time") + day(F.lit(60)))


@query(f"select {STATE} as state, count(*) as n, min(l_shipdate) as first_at, max(l_shipdate) as last_at from {JOINED} group by 1")
def asof_gate(spark, sf_dir):
    g = gated(spark, sf_dir).withColumn("gate_state", t.asof_state("observed_at", "cutoff", "kickoff"))
    return g.groupBy(F.col("gate_state").alias("state")).agg(F.count("*").alias("n"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))


@query(f"""select case when l_returnflag != 'N' then 'GATE_' || case l_returnflag when 'R' then 'REJECTED' else 'PENDING' end else {STATE} end as state, count(*) as n from {JOINED} group by 1""")
def odds_time_gate(spark, sf_dir):
    g = gated(spark, sf_dir).withColumn("gate", F.when(F.col("flag") == "R", "REJECTED").when(F.col("flag") == "A", "PENDING").otherwise("PASSED"))
    return g.groupBy(t.gated_state("gate", "observed_at", "cutoff", "kickoff").alias("state")).agg(F.count("*").alias("n"))


@query("""with r as (select event_id, user_id, event_type, value, ts, row_number() over (partition by user_id, event_type order by ts, event_id) as revision from events where user_id % 3 = 0 or ts <= timestamp '2024-01-15 00:00:00')
select user_id as provider, event_type as market, arg_max(event_id, row(revision, event_id)) as record_id, max(revision) as revision, arg_max(value, row(revision, event_id)) as price from r group by all""")
def visible_revision(spark, sf_dir):
    from pyspark.sql import Window

    cutoff = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    q = quotes(spark, sf_dir).drop("line").withColumn("domain", F.when(F.col("provider") % 3 == 0, "POST_MATCH").otherwise("PRE_MATCH"))
    w = Window.partitionBy("provider", "market").orderBy("source_time", "quote_id")
    known = q.where((F.col("domain") == "POST_MATCH") | (F.col("source_time") <= cutoff)).withColumn("revision", F.row_number().over(w).cast("long"))
    v = t.visible(known.withColumnRenamed("quote_id", "record_id"), cutoff, ["provider", "market"], "source_time")
    return v.select("provider", "market", "record_id", "revision", "price")


@query("""select user_id as provider, cast(sum(n) as bigint) as n, 'sha256:' || sha256(string_agg(d, chr(10) order by day)) as digest from
(select user_id, cast(ts as date) as day, count(*) as n, sha256(string_agg(event_id || '|' || event_type, chr(10) order by ts, event_id)) as d from events where ts <= timestamp '2024-01-10 00:00:00' group by all) group by user_id""")
def deterministic_snapshot(spark, sf_dir):
    q = quotes(spark, sf_dir).where("source_time <= timestamp_ntz '2024-01-10 00:00:00'")
    return t.snapshot_digest(q, ["provider"], F.to_date("source_time"), ["source_time", "quote_id"], ["quote_id", "market"])


@query("""select o_orderkey as match_id, coalesce(case when o_orderstatus = 'F' then o_orderdate end, case when o_orderstatus = 'O' then o_orderdate + interval 1 day end, o_orderdate + interval 2 day) as availability_at from orders""")
def availability_pick(spark, sf_dir):
    o = matches(spark, sf_dir)
    e = F.col("event_time")
    clocks = (F.when(F.col("status") == "F", e), F.when(F.col("status") == "O", e + F.make_dt_interval(F.lit(1))), e + F.make_dt_interval(F.lit(2)))
    return o.select("match_id", t.first_known(*clocks).alias("availability_at"))


@query(f"select array_to_string(list_filter([case when l_shipdate < o_orderdate + interval 5 day then 'CAPTURED_BEFORE_SOURCE' end, case when o_orderdate + interval 20 day < l_shipdate then 'INGESTED_BEFORE_CAPTURE' end, case when l_shipdate > o_orderdate + interval 30 day then 'AFTER_CUTOFF' end, case when l_tax > 0.07 then 'CUTOFF_AFTER_KICKOFF' end], lambda x: x is not null), ',') as failures, count(*) as n from {JOINED} group by 1")
def archive_times(spark, sf_dir):
    g = gated(spark, sf_dir)
    e = F.col("event_time")
    kickoff = F.when(F.col("tax") > 0.07, F.col("cutoff")).otherwise(F.col("kickoff"))
    found = t.record_times(e + F.make_dt_interval(F.lit(5)), "observed_at", e + F.make_dt_interval(F.lit(20)), "observed_at", "cutoff", kickoff)
    return g.groupBy(F.array_join(found, ",").alias("failures")).agg(F.count("*").alias("n"))


@query("select o_orderkey as match_id, case when o_orderstatus = 'P' then 'REVIEW' when o_orderdate >= timestamp '1999-01-01' then 'INELIGIBLE' else 'ELIGIBLE' end as evidence from orders")
def timestamp_evidence(spark, sf_dir):
    o = matches(spark, sf_dir)
    uploaded = F.when(F.col("status") != "P", F.col("event_time"))
    return o.select("match_id", t.upload_evidence(uploaded, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")).alias("evidence"))


@query("""with g as (select unnest([timestamp '1997-01-01', timestamp '1998-01-01', timestamp '1999-01-01']) as as_of),
f as (select case when o_orderpriority != '5-LOW' then o_orderdate end as v, case when o_orderpriority != '1-URGENT' then o_orderdate + interval 365 day end as e, o_orderdate + interval 10 day as r, as_of, case when o_orderstatus != 'P' then as_of + interval 20 day end as c, o_orderdate + interval 500 day as k from orders, g),
j as (select *, c is not null and (v is null or v > c or coalesce(r > c, false)) as ineligible, coalesce(c >= k, false) as late from f),
s as (select as_of, case when ineligible then 'FUTURE_DATA' when late then 'BLOCKED' when v is null then 'UNKNOWN_TIME' when v > as_of then 'FUTURE_DATA' when e < as_of then 'STALE' else 'CURRENT' end as state,
concat_ws(',', case when v is null then 'VALID_FROM_UNKNOWN_TIME' end, case when v > as_of then 'VALID_FROM_AFTER_AS_OF' end, case when v <= as_of and e < as_of then 'EXPIRED' end, case when late then 'CUTOFF_NOT_BEFORE_KICKOFF' end, case when ineligible then 'NOT_ELIGIBLE_AT_CUTOFF' end) as blockers, coalesce(e = as_of, false) as at_end from j)
select as_of, state, blockers, at_end, count(*) as n from s group by all""")
def freshness_grid(spark, sf_dir):
    """Facts against a declared grid of moments: three literals, so each row is laid out three times and nothing is joined."""
    grid = F.array(*(F.lit(x).cast("timestamp_ntz") for x in ("1997-01-01", "1998-01-01", "1999-01-01")))
    day, e = lambda n: F.make_dt_interval(F.lit(n)), F.col("event_time")
    o = matches(spark, sf_dir).select("status", "priority", e, F.explode(grid).alias("as_of"))
    valid, ends = F.when(F.col("priority") != "5-LOW", e), F.when(F.col("priority") != "1-URGENT", e + day(365))
    found = t.freshness(valid, ends, e + day(10), "as_of", F.when(F.col("status") != "P", F.col("as_of") + day(20)), e + day(500))
    o = o.select("as_of", found.alias("f"), F.coalesce(ends == F.col("as_of"), F.lit(False)).alias("at_end"))
    return o.groupBy("as_of", "f.state", F.array_join("f.blockers", ",").alias("blockers"), "at_end").agg(F.count("*").alias("n"))


@query("select o_orderkey as match_id, epoch_us(date_trunc('day', o_orderdate) + interval 8 hour) as early_us, epoch_us(date_trunc('day', o_orderdate) + interval 1170 minute) as late_us from orders")
def stage_cutoffs(spark, sf_dir):
    o = matches(spark, sf_dir)
    return o.select("match_id", F.unix_micros(stage_cutoff("event_time", 8)).alias("early_us"), F.unix_micros(stage_cutoff("event_time", 19, 30)).alias("late_us"))


@query("""select d, case d when 'P1D' then 86400 when 'PT2H30M' then 9000 when 'P2DT1S' then 172801 when 'PT15M' then 900 end::bigint as seconds, count(*) as n
from (select case event_id % 6 when 0 then 'P1D' when 1 then 'PT2H30M' when 2 then 'P2DT1S' when 3 then 'PT15M' when 4 then 'PT0S' else '1D' end as d from events) group by all""")
def iso_durations(spark, sf_dir):
    k = F.col("quote_id") % 6
    d = F.when(k == 0, "P1D").when(k == 1, "PT2H30M").when(k == 2, "P2DT1S").when(k == 3, "PT15M").when(k == 4, "PT0S").otherwise("1D")
    q = quotes(spark, sf_dir).select(d.alias("d"))
    return q.groupBy("d", iso_duration_seconds("d").alias("seconds")).agg(F.count("*").alias("n"))


@query("""with late as (select event_id, user_id, ts from events where ts > timestamp '2024-01-01' + to_days(cast(10 + user_id % 20 as integer)))
select user_id as provider, count(*) as late_rows from late group by 1""")
def late_rows(spark, sf_dir):
    """Lateness is a cutoff of each row's own, never the order of arrival."""
    q = quotes(spark, sf_dir)
    own = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((10 + F.col("provider") % 20).cast("int"))
    return q.where(F.col("source_time") > own).groupBy("provider").agg(F.count("*").alias("late_rows"))


@query("select o_orderkey as match_id, o_orderdate as cutoff_at from orders where o_orderdate < o_orderdate + to_days(cast(o_orderkey % 3 as integer))")
def valid_boundaries(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kickoff = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 3).cast("int"))
    return o.where(F.col("o_orderdate") < kickoff).select(F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("cutoff_at"))

"""Validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as v
from ..operators.timing import failures, ladder
from ..sources.driver_tables import observations, table
from .registry import query


@query("""select array_to_string(list_filter([case when o_totalprice < 20000 then 'LOW_VALUE' end, case when o_orderstatus = 'P' then 'PENDING' end, case when o_orderpriority = '5-LOW' then 'LOW_PRIORITY' end, case when o_orderdate > timestamp '2001-01-01' then 'TOO_LATE' end], lambda x: x is not null), ',') as failures, count(*) as n from orders group by 1""")
def training_sample_failures(spark, sf_dir):
    """Every failure of a sample, not only the first."""
    o = table(spark, sf_dir, "orders")
    f = failures((F.col("o_totalprice") < 20000, "LOW_VALUE"), (F.col("o_orderstatus") == "P", "PENDING"), (F.col("o_orderpriority") == "5-LOW", "LOW_PRIORITY"), (F.col("o_orderdate") > F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"), "TOO_LATE"))
    return o.groupBy(F.array_join(f, ",").alias("failures")).agg(F.count("*").alias("n"))


@query("""select role, count(*) filter (not (coalesce(o_orderstatus = 'P', false) or (o_totalprice < 100000 and role = 'HANDICAP'))) as eligible, count(*) as total from orders, (select unnest(['RESULT', 'HANDICAP', 'TOTAL', 'SCORE']) as role) r group by 1""")
def engine_eligibility(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = v.eligibility(o, ("RESULT", "HANDICAP", "TOTAL", "SCORE"), "HANDICAP", F.col("o_totalprice") < 100000, F.col("o_orderstatus") == "P")
    return e.groupBy("role").agg(F.count_if("eligible").alias("eligible"), F.count("*").alias("total"))


@query("""with p as (select event_id, case event_id % 7 when 0 then [value / 1000, 1 - value / 1000] when 1 then [value / 1000, 0.5] when 2 then [value / 100, 1 - value / 100] else [0.25, 0.75] end as p from events)
select case when len(list_filter(p, lambda x: x < 0 or x > 1)) > 0 then 'RANGE' when abs(list_sum(p) - 1) > 1e-6 then 'SUM' else 'OK' end as state, count(*) as n from p group by 1""")
def probability_vectors(spark, sf_dir):
    k, x = F.col("event_id") % 7, F.col("value")
    p = F.when(k == 0, F.array(x / 1000, 1 - x / 1000)).when(k == 1, F.array(x / 1000, F.lit(0.5))).when(k == 2, F.array(x / 100, 1 - x / 100)).otherwise(F.array(F.lit(0.25), F.lit(0.75)))
    e = table(spark, sf_dir, "events").select(p.alias("p"))
    return e.groupBy(v.probability_vector(F.col("p"), 2).alias("state")).agg(F.count("*").alias("n"))


@query("""select case when event_id % 11 = 0 then 'LABELS' when value <= 10 then 'PRICE' else 'OK' end as state, count(*) as n from events group by 1""")
def price_maps(spark, sf_dir):
    x = F.col("value") - 10
    m = F.when(F.col("event_id") % 11 == 0, F.create_map(F.lit("home"), F.lit(1.0))).otherwise(F.create_map(F.lit("home"), x, F.lit("draw"), F.lit(3.0), F.lit("away"), F.lit(2.0)))
    return table(spark, sf_dir, "events").select(m.alias("m")).groupBy(v.price_map("m", ["home", "draw", "away"]).alias("state")).agg(F.count("*").alias("n"))


@query("""select case when event_type = 'view' and (event_id % 5 = 0) then 'LINE_NOT_ALLOWED' when event_type != 'view' and event_id % 5 != 0 and event_id % 3 = 0 then 'LINE_MISSING' else 'OK' end as state, count(*) as n from events group by 1""")
def market_lines(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    one = F.col("event_type") == "view"
    rows = e.select(F.when(one, "EUROPEAN_1X2").otherwise("ASIAN_HANDICAP").alias("market"), F.when(k % 5 == 0, F.col("value")).alias("line"), F.when(one, "NOT_APPLICABLE").when(k % 3 == 0, "PRESENT").otherwise("UNKNOWN").alias("line_state"))
    return rows.groupBy(v.line_rule("market", "line", "line_state").alias("state")).agg(F.count("*").alias("n"))


@query("select doc_id, regexp_full_match(h, 'sha256:[0-9a-f]{64}') as valid from (select doc_id, case when doc_id % 5 = 0 then sha256(text) when doc_id % 5 = 1 then 'sha256:' || upper(sha256(text)) || 'F' else 'sha256:' || sha256(text) end as h from documents)")
def hash_domain(spark, sf_dir):
    h, k = F.sha2("text", 256), F.col("doc_id") % 5
    c = F.when(k == 0, h).when(k == 1, F.concat(F.lit("sha256:"), F.upper(h), F.lit("F"))).otherwise(F.concat(F.lit("sha256:"), h))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("h")).select("doc_id", v.is_hash("h").alias("valid"))


@query("""with s as (select l_orderkey as match, l_orderkey * 10 + l_linenumber as id, l_shipdate as fa, o_orderdate + interval 100 day as cut, o_orderdate + to_days(cast(95 + l_suppkey % 30 as integer)) as la, l_partkey % 2 as part from lineitem join orders on l_orderkey = o_orderkey)
select leak, count(*) as n from (select 'DUPLICATE_ID' as leak from s group by id having count(*) > 1 union all select 'FEATURE_AFTER_CUTOFF' from s where fa > cut union all select 'LABEL_BEFORE_CUTOFF' from s where la <= cut union all select 'MATCH_ACROSS_PARTITIONS' from s group by match having count(distinct part) > 1) group by 1""")
def leakage_scan(spark, sf_dir):
    x, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    day = lambda n: F.col("o_orderdate") + F.make_dt_interval(n)
    s = x.join(o, x.l_orderkey == o.o_orderkey).select(F.col("l_orderkey").alias("match"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("feature_at"), day(F.lit(100)).alias("cutoff"), day((95 + F.col("l_suppkey") % 30).cast("int")).alias("label_at"), (F.col("l_partkey") % 2).alias("part"))
    return v.leakage(s, "id", "feature_at", "cutoff", "label_at", "part", "match").groupBy("leak").agg(F.count("*").alias("n"))


@query("""select count(*) filter (a) as before_cutoff, count(*) filter (b) as priced, count(*) filter (c) as verified, count(*) filter (a and b and c) as passed, count(*) as total from (select l_shipdate < timestamp '1999-01-01' as a, l_extendedprice > 10000 as b, l_returnflag != 'R' as c from lineitem)""")
def point_in_time_gates(spark, sf_dir):
    g = v.all_gates(observations(spark, sf_dir), {"a": F.col("observed_at") < F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"), "b": F.col("price") > 10000, "c": F.col("flag") != "R"})
    return g.agg(F.count_if("a").alias("before_cutoff"), F.count_if("b").alias("priced"), F.count_if("c").alias("verified"), F.count_if("passed").alias("passed"), F.count("*").alias("total"))


@query("""select blocker, count(*) as n from (select unnest(list_filter([case when o_custkey is null then 'IDENTITY' end, case when o_totalprice < 50000 then 'VALUE' end, case when o_orderstatus = 'P' then 'STATUS' end, case when o_orderpriority like '5%' then 'RIGHTS' end], lambda x: x is not null)) as blocker from orders) group by 1""")
def intake_gates(spark, sf_dir):
    f = failures((F.col("o_custkey").isNull(), "IDENTITY"), (F.col("o_totalprice") < 50000, "VALUE"), (F.col("o_orderstatus") == "P", "STATUS"), (F.col("o_orderpriority").like("5%"), "RIGHTS"))
    return table(spark, sf_dir, "orders").select(F.explode(f).alias("blocker")).groupBy("blocker").agg(F.count("*").alias("n"))


@query("""select case when o_custkey % 13 = 0 then 'IDENTITY_HOLD' when o_orderpriority = '4-NOT SPECIFIED' then 'PROVENANCE_HOLD' when o_orderdate > timestamp '2001-01-01' then 'TEMPORAL_HOLD' when o_orderstatus = 'P' then 'RIGHTS_HOLD' else 'READY' end as status, count(*) as n from orders group by 1""")
def archive_ladder(spark, sf_dir):
    late = F.col("o_orderdate") > F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    s = ladder((F.col("o_custkey") % 13 == 0, "IDENTITY_HOLD"), (F.col("o_orderpriority") == "4-NOT SPECIFIED", "PROVENANCE_HOLD"), (late, "TEMPORAL_HOLD"), (F.col("o_orderstatus") == "P", "RIGHTS_HOLD"), otherwise="READY")
    return table(spark, sf_dir, "orders").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("""select kind, case when not regexp_full_match(t, '-?[0-9]+(\\.[0-9]+)?') then 'NOT_A_NUMBER' when kind = 'ODDS' and cast(t as double) <= 0 then 'NOT_POSITIVE' else 'OK' end as state, count(*) as n
from (select case when event_id % 2 = 0 then 'ODDS' else 'HANDICAP_LINE' end as kind, case event_id % 5 when 0 then '1.85' when 1 then '-0.5' when 2 then '1,85' when 3 then '0' else '.5' end as t from events) group by all""")
def manual_values(spark, sf_dir):
    k = F.col("event_id")
    t = F.when(k % 5 == 0, "1.85").when(k % 5 == 1, "-0.5").when(k % 5 == 2, "1,85").when(k % 5 == 3, "0").otherwise(".5")
    e = table(spark, sf_dir, "events").select(F.when(k % 2 == 0, "ODDS").otherwise("HANDICAP_LINE").alias("kind"), t.alias("t"))
    return e.groupBy("kind", v.manual_value("t", "kind").alias("state")).agg(F.count("*").alias("n"))


@query("""select d.doc_id from documents d join labels l on d.doc_id = l.doc_id where toxic = 0 and quality = 1 and not regexp_matches(lower(text), 'token|password|secret')""")
def public_projection(spark, sf_dir):
    """Published rows only, and none whose text speaks of secrets."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.where("toxic = 0 and quality = 1").where(~F.col("text").rlike("(?i)token|password|secret")).select("doc_id")


@query("""select case when o_orderstatus = 'F' then 'STORED' when o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice > 100000 then 'REPLAY' else 'REFUSED' end as path, count(*) as n from orders group by 1""")
def replay_path(spark, sf_dir):
    """A stored artifact is preferred; replay needs its proofs."""
    p = ladder((F.col("o_orderstatus") == "F", "STORED"), (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 100000), "REPLAY"), otherwise="REFUSED")
    return table(spark, sf_dir, "orders").groupBy(p.alias("path")).agg(F.count("*").alias("n"))


@query("""select array_to_string(list_filter([case when len(list_filter(['click', 'view', 'purchase'], lambda x: not list_contains(k, x))) > 0 then 'MISSING' end, case when len(list_filter(k, lambda x: x not in ('click', 'view', 'purchase'))) > 0 then 'UNDECLARED' end], lambda x: x is not null), ',') as problem, count(*) as providers
from (select user_id, coalesce(list(distinct event_type) filter (value > 400), cast([] as varchar[])) as k from events group by 1) group by 1""")
def feature_payloads(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 400, F.col("event_type"))).alias("k"))
    p = v.undeclared(F.col("k"), F.array(*map(F.lit, ("click", "view", "purchase"))))
    return g.groupBy(F.array_join(p, ",").alias("problem")).agg(F.count("*").alias("providers"))


@query("select distinct o_custkey as ref from orders where o_custkey not in (select c_custkey from customer where c_nationkey != 3)")
def dangling_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ref")).distinct()
    return v.dangling(refs, table(spark, sf_dir, "customer").where("c_nationkey != 3").select(F.col("c_custkey").alias("ref")), "ref")

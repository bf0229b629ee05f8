"""Typed projections: rows take their types, and carry the first rule they break."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.canonical import normal_text, sha256_id
from ..functions.times import micros
from ..operators.timing import failures, ladder
from ..sources.driver_tables import table
from .registry import query


@query("""select c_custkey as observation, trim(c_name) as name, case when c_custkey % 14 = 0 then null else c_acctbal end as value, case when c_custkey % 14 = 0 then 'VALUE_MISSING' when c_acctbal < -900 then 'VALUE_RANGE' when c_mktsegment = 'MACHINERY' and c_nationkey % 2 = 1 then 'SIDE_MISMATCH' when c_custkey % 6 = 1 then 'NOT_VERIFIED' end as error_code from customer""")
def observation_projection(spark, sf_dir):
    """Names in normal form, values finite and in range, side as the venue says, available only if verified."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("value", F.when(k % 14 != 0, F.col("c_acctbal")))
    code = ladder((F.col("value").isNull() | F.isnan("value"), "VALUE_MISSING"), (F.col("value") < -900, "VALUE_RANGE"), ((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") % 2 == 1), "SIDE_MISMATCH"), (k % 6 == 1, "NOT_VERIFIED"))
    return c.select(k.alias("observation"), normal_text("c_name").alias("name"), "value", code.alias("error_code"))


@query("""select case when o_orderstatus = 'F' and o_totalprice < 30000 then 'PAYLOAD_MISSING' when o_orderstatus != 'F' and o_orderpriority = '5-LOW' then 'REASON_MISSING' when o_orderstatus = 'P' and o_totalprice >= 30000 then 'PAYLOAD_NOT_ALLOWED' end as error_code, count(*) as n from orders group by 1""")
def fact_projection(spark, sf_dir):
    """A fact is available with a payload, or unavailable with a reason and without one."""
    o = table(spark, sf_dir, "orders").withColumn("payload", F.when(F.col("o_totalprice") >= 30000, F.col("o_totalprice"))).withColumn("reason", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    there = F.col("o_orderstatus") == "F"
    code = ladder((there & F.col("payload").isNull(), "PAYLOAD_MISSING"), (~there & F.col("reason").isNull(), "REASON_MISSING"), ((F.col("o_orderstatus") == "P") & F.col("payload").isNotNull(), "PAYLOAD_NOT_ALLOWED"))
    return o.groupBy(code.alias("error_code")).agg(F.count("*").alias("n"))


@query("""select case when l_returnflag = 'A' and l_discount = 0 then 'VALUE_MISSING' when l_returnflag != 'A' and l_tax = 0 then 'CODE_MISSING' when l_returnflag != 'A' and l_suppkey % 4 = 0 then 'DETAIL_MISSING' when l_partkey % 30 = 0 then 'PROVENANCE_MISSING' else 'OK' end as state, count(*) as n from lineitem group by 1""")
def feature_records(spark, sf_dir):
    """Missing is a state with a code and a detail; zero never stands for it."""
    x, there = table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "A"
    s = ladder((there & (F.col("l_discount") == 0), "VALUE_MISSING"), (~there & (F.col("l_tax") == 0), "CODE_MISSING"), (~there & (F.col("l_suppkey") % 4 == 0), "DETAIL_MISSING"), (F.col("l_partkey") % 30 == 0, "PROVENANCE_MISSING"), otherwise="OK")
    return x.groupBy(s.alias("state")).agg(F.count("*").alias("n"))


@query("""with b as (select l_orderkey as bundle, 'sha256:' || sha256(string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar)) as h from lineitem group by 1)
select bundle, h as refs_hash, h = case when bundle % 8 = 0 then 'sha256:' || sha256('x') else h end as matches from b""")
def bundle_hash(spark, sf_dir):
    """The hash of a bundle's sorted distinct references against the stated one; a bundle's references are few."""
    refs = F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",")
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bundle")).agg(sha256_id(refs).alias("refs_hash"))
    stated = F.when(F.col("bundle") % 8 == 0, sha256_id(F.lit("x"))).otherwise(F.col("refs_hash"))
    return b.withColumn("matches", F.col("refs_hash") == stated)


@query("""select array_to_string(list_filter([case when l_shipdate > o_orderdate + interval 90 day then 'AFTER_CUTOFF' end, case when l_suppkey % 9 = 0 then 'PROVENANCE' end, case when l_partkey % 41 = 0 then 'REFERENCE' end], lambda x: x is not null), ',') as failures, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def record_integrity(spark, sf_dir):
    x, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    f = failures((F.col("l_shipdate") > F.col("o_orderdate") + F.make_dt_interval(F.lit(90)), "AFTER_CUTOFF"), (F.col("l_suppkey") % 9 == 0, "PROVENANCE"), (F.col("l_partkey") % 41 == 0, "REFERENCE"))
    return x.join(o, x.l_orderkey == o.o_orderkey).groupBy(F.array_join(f, ",").alias("failures")).agg(F.count("*").alias("n"))


@query("""select event_id, epoch_us(ts) - case user_id % 4 when 0 then 0 when 1 then 3600000000 * 8 when 2 then 3600000000 * 9 end as utc_us from events""")
def timezone_normalise(spark, sf_dir):
    """Zone names by alias, then local times to UTC; an unknown zone gives null."""
    alias = F.create_map(*(F.lit(x) for x in ("Z", "UTC", "CST8", "Asia/Shanghai", "JST", "Asia/Tokyo")))
    k = F.col("user_id") % 4
    zone = F.try_element_at(alias, F.when(k == 0, "Z").when(k == 1, "CST8").when(k == 2, "JST").otherwise("??"))
    e = table(spark, sf_dir, "events").withColumn("zone", zone)
    utc = F.when(F.col("zone").isNotNull(), micros(F.convert_timezone(F.coalesce("zone", F.lit("UTC")), F.lit("UTC"), F.col("ts"))))
    return e.select("event_id", utc.alias("utc_us"))


@query("""select case when o_orderkey is null then 'SNAPSHOT_MISSING' when s_suppkey is null then 'GATE_MISSING' when l_shipdate < o_orderdate then 'TIME_MISMATCH' when s_nationkey % 5 != l_suppkey % 5 then 'REF_MISMATCH' else 'CONSISTENT' end as state, count(*) as n from lineitem left join (select * from orders where o_orderkey % 23 != 0) on l_orderkey = o_orderkey left join (select * from supplier where s_suppkey % 10 != 3) on l_suppkey = s_suppkey group by 1""")
def evidence_consistency(spark, sf_dir):
    """Snapshot, gate and evidence joined, with the first thing that does not agree."""
    x, o, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderkey % 23 != 0"), table(spark, sf_dir, "supplier").where("s_suppkey % 10 != 3")
    j = x.join(o, x.l_orderkey == o.o_orderkey, "left").join(s, x.l_suppkey == s.s_suppkey, "left")
    state = ladder((F.col("o_orderkey").isNull(), "SNAPSHOT_MISSING"), (F.col("s_suppkey").isNull(), "GATE_MISSING"), (F.col("l_shipdate") < F.col("o_orderdate"), "TIME_MISMATCH"), (F.col("s_nationkey") % 5 != F.col("l_suppkey") % 5, "REF_MISMATCH"), otherwise="CONSISTENT")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""select p_partkey as source, case p_type || '/' || (p_size % 3) when 'ECONOMY/0' then 'v1' when 'ECONOMY/1' then 'v2' when 'PROMO/0' then 'v3' end as adapter from part""")
def schema_adapters(spark, sf_dir):
    """An exact lookup by two parts of a key; what has no adapter keeps null."""
    adapters = spark.createDataFrame([("ECONOMY", 0, "v1"), ("ECONOMY", 1, "v2"), ("PROMO", 0, "v3")], "p_type string, version int, adapter string")
    p = table(spark, sf_dir, "part").withColumn("version", F.col("p_size") % 3)
    return p.join(F.broadcast(adapters), ["p_type", "version"], "left").select(F.col("p_partkey").alias("source"), "adapter")  # three declared rows

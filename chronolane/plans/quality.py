"""Quality queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators.revisions import current
from ..sources.driver_tables import observations, table
from .registry import query

STATE = "case when l_tax > 0.06 then 'STALE' when l_discount > 0.08 then 'CONFLICTED' when l_quantity < 3 then 'UNKNOWN' when l_tax = 0 then 'FUTURE_DATA' else 'AVAILABLE' end"


def features(spark, sf_dir):
    s = F.when(F.col("tax") > 0.06, "STALE").when(F.col("discount") > 0.08, "CONFLICTED").when(F.col("value") < 3, "UNKNOWN").when(F.col("tax") == 0, "FUTURE_DATA").otherwise("AVAILABLE")
    return observations(spark, sf_dir).withColumn("feature_state", s)


@query("select lang, case when l.doc_id is null then 'MISSING' when toxic = 1 then 'BLOCKED' else 'AVAILABLE' end as state, count(*) as n from documents d left join labels l on d.doc_id = l.doc_id group by all")
def missingness(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    s = F.when(F.col("id").isNull(), "MISSING").when(F.col("toxic") == 1, "BLOCKED").otherwise("AVAILABLE")
    return q.state_counts(d.join(l, d.doc_id == l.id, "left").withColumn("state", s), ["lang"], "state")


@query(f"""select l_orderkey as match_id, case when bool_and(s = 'AVAILABLE') then 'COMPLETE' else 'PARTIAL' end as completeness, case when bool_and(s = 'AVAILABLE') then 'VERIFIED' else 'PARTIAL' end as verification,
case when bool_or(s in ('STALE', 'FUTURE_DATA')) then 'UNKNOWN' else 'FRESH' end as freshness, case when bool_or(s = 'CONFLICTED') then 'PRESENT' else 'NONE' end as conflicts from (select *, {STATE} as s from lineitem) group by 1""")
def feature_quality(spark, sf_dir):
    return q.feature_quality(features(spark, sf_dir), ["match_id"], "feature_state")


@query(f"""select l_suppkey as source_id, case when bool_or(s = 'CONFLICTED') then 'BLOCKED' when bool_or(s = 'STALE') then 'PARTIAL' else 'PASS' end as freshness,
case when bool_or(s = 'FUTURE_DATA' and l_quantity > 45) then 'BLOCKED' when bool_or(s = 'UNKNOWN') then 'PARTIAL' else 'PASS' end as coverage from (select *, {STATE} as s from lineitem) group by 1""")
def quality_dimensions(spark, sf_dir):
    s = F.col("feature_state")
    return features(spark, sf_dir).groupBy("source_id").agg(q.dimension(s == "CONFLICTED", s == "STALE").alias("freshness"), q.dimension((s == "FUTURE_DATA") & (F.col("value") > 45), s == "UNKNOWN").alias("coverage"))


@query(f"""select l_orderkey as match_id, count(distinct l_suppkey) as sources, array_to_string(list_sort(list(distinct l_returnflag)), ',') as codes, count(*) filter (s = 'AVAILABLE') as available, count(*) filter (s != 'AVAILABLE') as missing from (select *, {STATE} as s from lineitem) group by 1""")
def quality_counts(spark, sf_dir):
    s = F.col("feature_state") == "AVAILABLE"
    return features(spark, sf_dir).groupBy("match_id").agg(F.count_distinct("source_id").alias("sources"), F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("codes"), F.count_if(s).alias("available"), F.count_if(~s).alias("missing"))


@query("""select case grouping(l_returnflag) * 2 + grouping(l_linestatus) when 0 then 'FEATURE' when 1 then 'DOMAIN' else 'CANDIDATE_SET' end as scope, l_returnflag as domain, l_linestatus as feature,
list_extract(['ELIGIBLE', 'PARTIALLY_ELIGIBLE', 'INELIGIBLE', 'BLOCKED'], max(case when l_returnflag = 'R' and l_quantity > 49 then 4 when l_tax > 0.07 then 3 when l_discount > 0.09 then 2 else 1 end)) as gate, count(*) as n
from lineitem where l_returnflag != 'A' or l_tax < 0.05 group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def quality_gate_rollup(spark, sf_dir):
    o = observations(spark, sf_dir).where("flag != 'A' or tax < 0.05")
    s = F.when((F.col("flag") == "R") & (F.col("value") > 49), "BLOCKED").when(F.col("tax") > 0.07, "INELIGIBLE").when(F.col("discount") > 0.09, "PARTIALLY_ELIGIBLE").otherwise("ELIGIBLE")
    return q.gate_rollup(o.withColumn("s", s).withColumnRenamed("flag", "domain").withColumnRenamed("state", "feature"), "domain", "feature", "s")


@query("""with c as (select source as claim, count(distinct l.quality) as contents, coalesce(bool_or(l.toxic = 1), false) as contradicted from documents d join labels l on d.doc_id = l.doc_id group by 1)
select claim, contents, contradicted, case when (contents > 1 or contradicted) and claim in ('src1', 'src3') then 'RESOLVED' when contents > 1 or contradicted then 'CONFLICTED' else 'CONSISTENT' end as claim_state from c""")
def claim_conflict(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("claim")).join(table(spark, sf_dir, "labels"), "doc_id")
    resolutions = table(spark, sf_dir, "documents").select(F.col("source").alias("claim")).where("claim in ('src1', 'src3')")
    return q.claims(d, "claim", "quality", F.col("toxic") == 1, resolutions)


@query("""with l as (select conv_id, arg_max(role, row(turn, role)) as status, max(turn) as revision from conversations group by 1) select conv_id % 5 as market, count(*) filter (status = 'assistant') as answered, count(*) filter (status = 'user') as open, count(*) - count(*) filter (status = 'assistant') as remaining from l group by 1""")
def review_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    l = current(c, ["conv_id"], "turn", "role")
    return l.groupBy((F.col("conv_id") % 5).alias("market")).agg(F.count_if(F.col("role") == "assistant").alias("answered"), F.count_if(F.col("role") == "user").alias("open"), (F.count("*") - F.count_if(F.col("role") == "assistant")).alias("remaining"))


@query("""with r as (select event_id // 3 as cell, user_id % 3 as engine, case when value < 100 then null else cast(value as int) % 3 end as v from events), g as (select cell, count(distinct v) as vals, count(distinct case when v is not null then engine end) as engines, min(v) as only_ from r group by 1)
select cell, vals, engines, case when vals = 0 then 'UNRESOLVED' when vals > 1 then 'CONFLICT' when engines >= 2 then 'CONFIRMED' else 'SINGLE_ENGINE' end as consensus, case when vals = 1 then only_ end as value from g""")
def ocr_consensus(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select(F.floor(F.col("event_id") / 3).alias("cell"), (F.col("user_id") % 3).alias("engine"), F.when(F.col("value") >= 100, F.bround("value").cast("int") % 3).alias("v"))
    return q.consensus(r, ["cell"], "v", "engine")


@query("select user_id as provider, event_type as market, count(distinct props) as payloads, count(distinct props) > 1 as conflict from events group by all")
def payload_conflicts(spark, sf_dir):
    n = F.count_distinct("props")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("provider"), F.col("event_type").alias("market")).agg(n.alias("payloads"), (n > 1).alias("conflict"))


@query("""with g as (select o_custkey as team, list(o_orderkey) filter (o_orderstatus = 'F') as items, count(distinct o_orderpriority) as refs, case o_custkey % 4 when 0 then 'UNKNOWN' when 1 then 'NONE_CONFIRMED' when 2 then 'AVAILABLE' else 'CONFLICTED' end as s from orders group by o_custkey)
select s as state, case when s = 'UNKNOWN' and items is not null then 'UNKNOWN_WITH_ITEMS' when s = 'NONE_CONFIRMED' and (items is not null) then 'NONE_NOT_CONFIRMED' when s = 'AVAILABLE' and items is null then 'AVAILABLE_EMPTY' when s = 'CONFLICTED' and refs < 2 then 'CONFLICT_WITHOUT_TWO' else 'OK' end as problem, count(*) as n from g group by all""")
def collection_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 4
    s = F.when(k == 0, "UNKNOWN").when(k == 1, "NONE_CONFIRMED").when(k == 2, "AVAILABLE").otherwise("CONFLICTED")
    g = o.groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("items"), F.collect_set("o_orderpriority").alias("refs")).withColumn("state", s)
    g = g.withColumn("items", F.when((F.col("state") == "UNKNOWN") & (F.size("items") == 0), F.lit(None)).otherwise(F.col("items")))
    return g.groupBy("state", q.collection_state("state", "items", "refs").alias("problem")).agg(F.count("*").alias("n"))


@query("""select o_custkey as team, count(*) as picked, count(distinct o_orderkey % 25) as players, count(*) = count(distinct o_orderkey % 25) as unique_players from orders group by 1""")
def lineup_players(spark, sf_dir):
    """A lineup names each player once."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("team"), (F.col("o_orderkey") % 25).alias("player"))
    return q.lineups(o, "team", "player")

"""Row functions, small rule tables and sample building on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators.lineage import orphans
from ..operators.samples import also_accepted, grid, horizon, latest_is_canonical
from ..operators.samples import source_time_order as time_order
from ..operators.timing import failures, ladder
from ..sources.driver_tables import quotes, table
from .registry import query


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query('select event_id, cast(floor(value / 3) as bigint) as "left", cast(floor(value / 7) as bigint) as top, cast(ceil(value / 2) as bigint) as "right", cast(ceil(value / 5) as bigint) as bottom from events')
def rect_projection(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", s.whole_rect(v / 3, v / 7, v / 2, v / 5).alias("r")).select("event_id", "r.*")


@query("select event_id, case when event_id % 3 = 0 then 0 when value > 200 then 1 when value < 200 then -1 else 0 end as sign from events")
def signs(spark, sf_dir):
    t = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise((F.col("value") - 200).cast("string"))
    return events(spark, sf_dir).withColumn("t", t).select("event_id", s.sign("t").alias("sign"))


@query("select event_id, case event_type when 'click' then 'HOME' when 'view' then 'DRAW' when 'purchase' then 'AWAY' else 'OTHER' end as label from events")
def label_map(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", s.recoded("event_type", {"click": "HOME", "view": "DRAW", "purchase": "AWAY"}, "OTHER").alias("label"))


@query("select event_id, round(case when value > 1 then 1 / value end, 8) as implied from events")
def fair_shares(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(s.fair_share("value"), 8).alias("implied"))


@query("select event_type as kind, case when event_id % 10 = 0 then 'STATED' when event_type like '%error%' then 'POST_MATCH' when event_type like '%click%' then 'MARKET' else 'PRE_MATCH' end as domain, count(*) as n from events group by all")
def domain_inference(spark, sf_dir):
    kind = s.recoded("event_type", {"error": "match_result", "click": "Odds_main"}, "lineup")
    e = events(spark, sf_dir).select(F.col("event_type").alias("kind"), s.artifact_domain(F.when(F.col("event_id") % 10 == 0, "STATED"), kind).alias("domain"))
    return e.groupBy("kind", "domain").agg(F.count("*").alias("n"))


@query("select case when event_id % 2 = 0 and event_id % 3 = 0 and user_id % 4 != 0 then 'CONFLICT' when event_id % 2 = 0 or event_id % 3 = 0 then case when event_id % 2 = 0 then 'x' else case when user_id % 4 = 0 then 'x' else 'y' end end end as value, count(*) as n from events group by 1")
def alias_coverage(spark, sf_dir):
    k = F.col("event_id")
    v = s.either_name(F.when(k % 2 == 0, "x"), F.when(k % 3 == 0, F.when(F.col("user_id") % 4 == 0, "x").otherwise("y")))
    return events(spark, sf_dir).groupBy(v.alias("value")).agg(F.count("*").alias("n"))


@query("select case when a = b and b = c then 'UNANIMOUS' when a = b or b = c or a = c then 'MAJORITY' else 'DISPUTED' end as decision, count(*) as n from (select event_id % 3 as a, user_id % 3 as b, event_id % 2 as c from events) group by 1")
def vision_decision(spark, sf_dir):
    d = s.agreed(F.col("event_id") % 3, F.col("user_id") % 3, F.col("event_id") % 2)
    return events(spark, sf_dir).groupBy(d.alias("decision")).agg(F.count("*").alias("n"))


@query("select event_id, case when user_id % 5 != 0 then value end as home, case when user_id % 5 != 0 then value / 2 end as away from events")
def cells_to_map(spark, sf_dir):
    """Cells become a map; a label that comes twice voids it."""
    cell = lambda n, v: F.struct(F.lit(n).alias("label"), v.alias("value"))
    second = F.when(F.col("user_id") % 5 == 0, F.lit("home")).otherwise(F.lit("away"))
    cells = F.array(cell("home", F.col("value")), F.struct(second.alias("label"), (F.col("value") / 2).alias("value")))
    m = events(spark, sf_dir).select("event_id", s.cells_map(cells).alias("m"))
    return m.select("event_id", F.col("m")["home"].alias("home"), F.col("m")["away"].alias("away"))


@query("""with r as (select event_id, user_id, case when event_id % 9 != 0 then ts end as t from events) select user_id as provider, event_id as quote_id, cast(row_number() over (partition by user_id order by t asc nulls last, event_id) as integer) as place, bool_or(t is null) over (partition by user_id) as blocked from r""")
def source_time_order(spark, sf_dir):
    """Known times first; one ambiguous time blocks the set."""
    q = quotes(spark, sf_dir).withColumn("t", F.when(F.col("quote_id") % 9 != 0, F.col("source_time")))
    return time_order(q, ["provider"], "t", "quote_id").select("provider", "quote_id", "place", "blocked")


@query("select distinct p_name as name, p_brand as ref from part where p_size <= 25 and (p_name, p_brand) in (select (p_name, p_brand) from part where p_size > 25)")
def exclusion_manifest(spark, sf_dir):
    """Excluded pairs that are also accepted; the result of a sound manifest is empty."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("ref"), "p_size")
    return also_accepted(p.where("p_size <= 25"), p.where("p_size > 25"), ["name", "ref"])


@query("select n_name as league, play, n_nationkey * 5 + k as sample from nation, (select unnest(['RESULT', 'HANDICAP', 'TOTAL', 'SCORE', 'HALF']) as play, unnest([0, 1, 2, 3, 4]) as k) x")
def sample_grid(spark, sf_dir):
    """Declared leagues by declared plays."""
    leagues = table(spark, sf_dir, "nation").withColumnRenamed("n_name", "league")
    return grid(leagues, ("RESULT", "HANDICAP", "TOTAL", "SCORE", "HALF"), F.col("n_nationkey")).select("league", "play", "sample")


@query("select case when p_type in ('ECONOMY') then 'DENIED' when p_brand not in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#17') then 'NOT_ALLOWED' else 'GRANTED' end as rights, count(*) as n from part group by 1")
def rights_gate(spark, sf_dir):
    g = ladder((F.col("p_type").isin("ECONOMY"), "DENIED"), (~F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3", "Brand#17"), "NOT_ALLOWED"), otherwise="GRANTED")
    return table(spark, sf_dir, "part").groupBy(g.alias("rights")).agg(F.count("*").alias("n"))


@query("select flag, count(*) as n from (select unnest(list_filter([case when l_returnflag = 'R' and l_tax > 0.05 then 'PAYLOAD_WITHOUT_AVAILABILITY' end, case when l_returnflag = 'A' and l_discount < 0.02 then 'REASON_MISSING' end, case when l_linestatus = 'F' and l_suppkey % 2 = 0 then 'ROLE_MIXED' end], lambda x: x is not null)) as flag from lineitem) group by 1")
def market_payload_rules(spark, sf_dir):
    """Available needs a payload, unavailable a reason; official and external sources stay apart."""
    f = failures(((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.05), "PAYLOAD_WITHOUT_AVAILABILITY"), ((F.col("l_returnflag") == "A") & (F.col("l_discount") < 0.02), "REASON_MISSING"), ((F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 2 == 0), "ROLE_MIXED"))
    return table(spark, sf_dir, "lineitem").select(F.explode(f).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("select o_orderkey as run from orders where not (o_orderdate + to_days(cast(o_orderkey % 9 as integer)) <= o_orderdate + interval 6 day and o_orderdate + to_days(cast(o_custkey % 12 as integer)) < o_orderdate + interval 10 day)")
def prematch_violations(spark, sf_dir):
    """Runs that were generated after the cutoff or completed at kickoff or later."""
    o, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    days = lambda c: d + F.make_dt_interval(c.cast("int"))
    good = (days(F.col("o_orderkey") % 9) <= days(F.lit(6))) & (days(F.col("o_custkey") % 12) < days(F.lit(10)))
    return o.where(~good).select(F.col("o_orderkey").alias("run"))


@query("""select l_orderkey as match_id, min(l_shipdate) as first_at, max(l_shipdate) as last_at, count(distinct l_suppkey) as refs from lineitem group by 1""")
def feature_horizon(spark, sf_dir):
    return horizon(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "match_id"), "match_id", "l_shipdate", "l_suppkey")


@query("""select user_id as sample, coalesce(arg_max(value, row(ts, event_id)) filter (event_type = 'click'), -1) as click, coalesce(arg_max(value, row(ts, event_id)) filter (event_type = 'view'), -1) as view, coalesce(arg_max(value, row(ts, event_id)) filter (event_type = 'error' and value > 450), -1) as error from events group by 1""")
def sample_pivot(spark, sf_dir):
    """One row a sample: the latest value of each domain, a sentinel where there is none."""
    at = lambda c: F.coalesce(F.max_by(F.when(c, F.col("value")), F.when(c, F.struct("ts", "event_id"))), F.lit(-1.0))
    t = F.col("event_type")
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("sample")).agg(at(t == "click").alias("click"), at(t == "view").alias("view"), at((t == "error") & (F.col("value") > 450)).alias("error"))


@query("""with recursive_ as (select c_custkey as child, c_custkey - c_nationkey as parent from customer), n as (select c_custkey as node from customer where c_custkey % 3 != 0) select count(*) as edges, count(*) filter (parent not in (select node from n)) as orphans from recursive_""")
def lineage_orphans(spark, sf_dir):
    """Edges whose parent no node declares."""
    e = table(spark, sf_dir, "customer").select((F.col("c_custkey") - F.col("c_nationkey")).alias("parent"))
    n = table(spark, sf_dir, "customer").where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("node"))
    found = orphans(e.withColumn("child", F.lit(0)), n, "child", "parent", "node")
    return found.agg(F.count("*").alias("edges"), F.count_if("orphan").alias("orphans"))


@query("""with c as (select o_custkey, max(o_orderdate) as top, arg_max(o_orderdate, o_orderkey) as canonical from orders group by 1) select canonical = top as consistent, count(*) as teams from c group by 1""")
def latest_consistency(spark, sf_dir):
    """Whether the last inserted row also has the latest business time."""
    c = latest_is_canonical(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return c.groupBy("consistent").agg(F.count("*").alias("teams"))


@query("""with b as (select c_custkey as k, c_mktsegment as v from customer where c_mktsegment != 'BUILDING'), a as (select c_custkey as k, case when c_nationkey = 3 then 'NEW' else c_mktsegment end as v, c_nationkey % 5 = 0 as expected from customer where c_acctbal >= 0 or c_mktsegment = 'BUILDING')
select case when b.k is null then case when expected then 'EXPECTED_ADDITION' else 'UNEXPECTED_ADDITION' end when a.k is null then 'REMOVED' when a.v != b.v then 'CHANGED' else 'PRESERVED' end as outcome, count(*) as n from b full outer join a on a.k = b.k group by 1""")
def post_apply_classes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    b = c.where("c_mktsegment != 'BUILDING'").select(F.col("c_custkey").alias("bk"), F.col("c_mktsegment").alias("bv"))
    a = c.where("c_acctbal >= 0 or c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("ak"), F.when(F.col("c_nationkey") == 3, "NEW").otherwise(F.col("c_mktsegment")).alias("av"), (F.col("c_nationkey") % 5 == 0).alias("expected"))
    o = ladder((F.col("bk").isNull() & F.col("expected"), "EXPECTED_ADDITION"), (F.col("bk").isNull(), "UNEXPECTED_ADDITION"), (F.col("ak").isNull(), "REMOVED"), (F.col("av") != F.col("bv"), "CHANGED"), otherwise="PRESERVED")
    return b.join(a, F.col("ak") == F.col("bk"), "full_outer").groupBy(o.alias("outcome")).agg(F.count("*").alias("n"))


@query("""select s_nationkey as nation, count(*) as suppliers, round(avg(s_acctbal), 4) as mean_balance, round(stddev_pop(s_acctbal), 4) as deviation, round(median(s_acctbal), 4) as middle from supplier group by 1""")
def provider_profile(spark, sf_dir):
    """Exact moments and medians; no approximation stands in for them."""
    b = "s_acctbal"
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"), F.round(F.avg(b), 4).alias("mean_balance"), F.round(F.stddev_pop(b), 4).alias("deviation"), F.round(F.median(b), 4).alias("middle"))

"""Statistics of teams (customers) over matches (orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as s
from ..operators.timing import ladder
from ..sources.driver_tables import matches, observations, table
from .registry import query

RECENT = """with r as (select *, dense_rank() over (partition by o_custkey order by o_orderdate desc, o_orderkey) - 1 as k from orders),
w as (select *, exp(-ln(2) * k / 10.0) as w from r where k < 20),
ratings as (select o_custkey as team_id, sum(w * o_totalprice) / sum(w) as rating, count(*) as n, count(distinct o_orderkey) as m from w group by 1)
"""


@query(RECENT + "select o_custkey as team_id, o_orderkey as match_id, cast(k as integer) as recency from w")
def last_matches(spark, sf_dir):
    return s.recent(matches(spark, sf_dir), ["team_id"]).select("team_id", "match_id", "recency")


@query(RECENT + "select team_id, round(case when n >= 5 then rating end, 4) as rating, n as rows, m as matches, case when n >= 5 then 'AVAILABLE' else 'UNKNOWN' end as state from ratings")
def team_rating_decay(spark, sf_dir):
    r = s.rating(matches(spark, sf_dir), "team_id", "value")
    return r.select("team_id", F.round("rating", 4).alias("rating"), "rows", "matches", "state")


@query(RECENT + """select o_custkey as team_id, round(sum(w * o_totalprice) filter (o_orderstatus = 'F') / sum(w) filter (o_orderstatus = 'F'), 4) as attack,
round(sum(w * o_totalprice) filter (o_orderstatus = 'O') / sum(w) filter (o_orderstatus = 'O'), 4) as defence, bool_or(o_orderstatus = 'P') as home_blocked from w group by 1""")
def attack_defence(spark, sf_dir):
    r = s.recent(matches(spark, sf_dir), ["team_id"])
    side = lambda x: F.round(s.decayed_mean("value", 10.0, F.col("status") == x), 4)
    return r.groupBy("team_id").agg(side("F").alias("attack"), side("O").alias("defence"), F.max(F.col("status") == "P").alias("home_blocked"))


@query(RECENT + """, a as (select *, (o_custkey * 7 + 13) % (select max(c_custkey) + 1 from customer) as opp from w)
select o_custkey as team_id, round(sum(w * (o_totalprice - rating)) / sum(w), 3) as adjusted, count(*) as rows from a join ratings on opp = team_id and n >= 5 group by 1""")
def opponent_adjusted(spark, sf_dir):
    m = matches(spark, sf_dir)
    teams = table(spark, sf_dir, "customer").agg((F.max("c_custkey") + 1).alias("teams"))
    m = m.crossJoin(F.broadcast(teams)).withColumn("opponent_id", (F.col("team_id") * 7 + 13) % F.col("teams"))  # one row
    a = s.opponent_adjusted(m, s.rating(m, "team_id", "value"), "team_id", "opponent_id", "value")
    return a.select("team_id", F.round("adjusted", 3).alias("adjusted"), "rows")


@query("""select l_orderkey as match_id, a - b as difference from (select l_orderkey, arg_max(l_quantity, k) filter (l_returnflag = 'R') as a, arg_max(l_quantity, k) filter (l_returnflag = 'A') as b
from (select *, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem) group by 1) where a is not null and b is not null""")
def home_diff_pivot(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("k", F.struct("line_no", "part_id", "source_id", "price"))
    return s.paired(o, "match_id", "flag", "value", "k", "R", "A")


@query("""with p as (select n_name, n_regionkey, o.*, dense_rank() over (partition by n_nationkey order by o_orderdate desc, o_orderkey) - 1 as k from orders o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
w as (select *, exp(-ln(2) * k / 10.0) as w from p where k < 40) select n_name as league, round(sum(w * o_totalprice) / sum(w), 4) as strength, count(distinct o_orderkey) as matches, count(distinct o_orderkey) >= 20 as enough from w group by 1""")
def league_strength(spark, sf_dir):
    """Teams of a league pool their matches under one rank; leagues are nations, a fixed small dimension."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    m = matches(spark, sf_dir).join(c.select(F.col("c_custkey").alias("team_id"), "c_nationkey"), "team_id").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    r = s.recent(m, ["n_nationkey"], 40)
    return r.groupBy(F.col("n_name").alias("league")).agg(F.round(s.decayed_mean("value", 10.0), 4).alias("strength"), F.count_distinct("match_id").alias("matches"), (F.count_distinct("match_id") >= 20).alias("enough"))


@query("""with x as (select l.*, case when l_partkey % 50 = 0 then 'TARGET_MATCH' when l_linestatus = 'F' and l_returnflag = 'R' then 'STATUS' when l_shipdate > timestamp '2001-01-01' then 'FUTURE' when l_tax > 0.07 then 'REVISION' when l_shipdate < timestamp '1996-01-01' then 'WINDOW_EXCLUDED' end as reason from lineitem l)
select reason, case when reason = 'WINDOW_EXCLUDED' then count(distinct l_orderkey) else count(*) end as n from x where reason is not null group by 1""")
def exclusion_histogram(spark, sf_dir):
    """Each row's first failing reason, in a fixed order, then counts."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    reason = ladder(
        (F.col("part_id") % 50 == 0, "TARGET_MATCH"), ((F.col("state") == "F") & (F.col("flag") == "R"), "STATUS"), (F.col("observed_at") > at("2001-01-01 00:00:00"), "FUTURE"),
        (F.col("tax") > 0.07, "REVISION"), (F.col("observed_at") < at("1996-01-01 00:00:00"), "WINDOW_EXCLUDED"),
    )
    return s.exclusions(observations(spark, sf_dir), reason)

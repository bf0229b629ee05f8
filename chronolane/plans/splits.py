"""Split queries on orders and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as s
from ..sources.driver_tables import matches, table
from .registry import query

TS = "timestamp '{}'"


def at(x):
    return F.lit(x).cast("timestamp_ntz")


@query("""with g as (select l_orderkey as match_id, min(l_shipdate) as a, max(l_shipdate) as b from lineitem group by 1), f as (select *, (a >= timestamp '1995-01-01' and b <= timestamp '1998-06-30')::int as t, (a >= timestamp '1998-06-30' and b <= timestamp '2000-01-01')::int as v, (a >= timestamp '1999-12-01' and b <= timestamp '2002-01-01')::int as h from g)
select case when t + v + h = 0 then 'NONE' when t + v + h > 1 then 'SEVERAL' when t = 1 then 'train' when v = 1 then 'validation' else 'holdout' end as partition, count(*) as matches from f group by 1""")
def explicit_split(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_shipdate").alias("at"))
    parts = [("train", at("1995-01-01"), at("1998-06-30")), ("validation", at("1998-06-30"), at("2000-01-01")), ("holdout", at("1999-12-01"), at("2002-01-01"))]
    return s.explicit_split(x, "match_id", "at", parts).groupBy("partition").agg(F.count("*").alias("matches"))


@query("""with f as (select row_number() over (order by origin) - 1 as fold, origin from (select unnest(generate_series(timestamp '1997-01-01', timestamp '2000-06-01', interval 180 day)) as origin)),
p as (select fold, case when o_orderdate >= timestamp '1995-01-01' and o_orderdate <= origin then 'train' when o_orderdate > origin and o_orderdate <= origin + interval 90 day then 'validation' when o_orderdate > origin + interval 90 day and o_orderdate <= origin + interval 180 day then 'holdout' end as partition from orders, f)
select cast(fold as integer) as fold, partition, count(*) as matches from p where partition is not null group by all""")
def walk_forward(spark, sf_dir):
    f = s.folds(spark, "1995-01-01", "1997-01-01", "2000-06-01", 180)
    return s.walk_forward(matches(spark, sf_dir), f, "match_id", "event_time", 90, 90).groupBy("fold", "partition").agg(F.count("*").alias("matches"))


THIRDS = """with r as (select o_orderkey, o_custkey, o_orderstatus, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as i, count(*) over (partition by o_custkey) as n from orders),
thirds as (select *, case when i < n // 3 then 'train' when i < 2 * n // 3 then 'validation' else 'test' end as partition from r)
"""


def thirds(spark, sf_dir):
    return s.floor_thirds(matches(spark, sf_dir), ["team_id"], "event_time", "match_id")


@query(THIRDS + "select o_orderkey as match_id, partition from thirds")
def thirds_split(spark, sf_dir):
    """Thirds of each team's matches in time."""
    return thirds(spark, sf_dir).select("match_id", "partition")


@query("""with g as (select o_custkey as team_id, min(o_orderdate) as first_at from orders group by 1), r as (select g.*, c_nationkey, row_number() over (partition by c_nationkey order by first_at, team_id) - 1 as i, count(*) over (partition by c_nationkey) as n from g join customer on team_id = c_custkey)
select team_id, case when i < n // 3 then 'train' when i < 2 * n // 3 then 'validation' else 'test' end as partition from r""")
def group_thirds(spark, sf_dir):
    """Whole groups in order of their first time, in thirds within a league."""
    g = matches(spark, sf_dir).groupBy("team_id").agg(F.min("event_time").alias("first_at"))
    g = g.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team_id"), "c_nationkey"), "team_id")
    return s.floor_thirds(g, ["c_nationkey"], "first_at", "team_id").select("team_id", "partition")


@query(THIRDS + "select o_custkey as team_id, count(distinct partition) as partitions from thirds group by 1 having count(distinct partition) > 1")
def split_overlap(spark, sf_dir):
    return s.overlap(thirds(spark, sf_dir), "team_id", "partition")


@query(THIRDS + "select partition, count(*) as n, min(o_orderdate) as first_at, max(o_orderdate) as last_at from thirds group by 1")
def temporal_coverage(spark, sf_dir):
    return thirds(spark, sf_dir).groupBy("partition").agg(F.count("*").alias("n"), F.min("event_time").alias("first_at"), F.max("event_time").alias("last_at"))


@query(THIRDS + "select o_orderstatus as role, count(*) filter (partition = 'train') as train, count(*) filter (partition = 'validation') as validation, count(*) filter (partition = 'test') as test, count(*) filter (partition = 'train') >= 5 and count(*) filter (partition = 'validation') >= 3 and count(*) filter (partition = 'test') >= 3 as ready from thirds group by 1")
def readiness(spark, sf_dir):
    t = thirds(spark, sf_dir).groupBy(F.col("status").alias("role")).pivot("partition", ["train", "validation", "test"]).count()
    t = t.na.fill(0, ["train", "validation", "test"])
    return t.withColumn("ready", (F.col("train") >= 5) & (F.col("validation") >= 3) & (F.col("test") >= 3))


@query("""with d as (select lang, toxic from documents d join labels l on d.doc_id = l.doc_id), t as (select lang, count(*) as total from d group by 1), c as (select lang, toxic, count(*) as n from d group by all),
e as (select t.lang, k.toxic, total, coalesce(n, 0) as support from t cross join (select unnest([0, 1, 2]) as toxic) k left join c on c.lang = t.lang and c.toxic = k.toxic)
select lang, toxic, support, round(support / total, 6) as rate, min(support) over (partition by lang) >= 1 as enough from e""")
def class_support(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    classes = spark.range(3).select(F.col("id").cast("int").alias("toxic"))
    return s.support(d, "lang", "toxic", classes, 1).select("lang", "toxic", "support", F.round("rate", 6).alias("rate"), "enough")


@query("""select feature, round(rate, 6) as rate from (select avg((quality is not null)::int) as quality, avg((toxic = 1 or null is not null)::int) as toxic_, avg(case when n_chars > 500 then 1.0 else 0.0 end) as long_text, avg(case when quality is not null and toxic = 1 and n_chars > 500 then 1.0 else 0.0 end) as all_ from documents d left join labels l on d.doc_id = l.doc_id),
lateral (select unnest(['quality', 'toxic', 'long_text', 'ALL']) as feature, unnest([quality, coalesce((select avg(case when toxic = 1 then 1.0 else 0.0 end) from documents d left join labels l on d.doc_id = l.doc_id), 0), long_text, all_]) as rate)""")
def feature_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    f = d.select("quality", F.when(F.col("toxic") == 1, 1).alias("toxic"), F.when(F.col("n_chars") > 500, 1).alias("long_text"))
    return s.coverage(f, ["quality", "toxic", "long_text"]).select("feature", F.round("rate", 6).alias("rate"))


@query("""with seen as (select distinct n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 400000) select n_name as league, n_name in (select n_name from seen) as covered from nation""")
def league_coverage(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    seen = table(spark, sf_dir, "orders").where("o_totalprice > 400000").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("seen")).distinct()
    return n.join(seen, n.n_nationkey == seen.seen, "left").select(F.col("n_name").alias("league"), F.col("seen").isNotNull().alias("covered"))


@query("""with x as (select o_custkey, case when o_totalprice > 300000 then 'UNSTABLE' when o_orderstatus = 'P' and o_totalprice > 200000 then 'UNKNOWN' else 'PASS' end as s from orders) select o_custkey as team_id, case when bool_and(s = 'PASS') then 'PASS' when bool_or(s = 'UNKNOWN') then 'UNKNOWN' else 'UNSTABLE' end as stability from x group by 1""")
def stability(spark, sf_dir):
    x = F.when(F.col("value") > 300000, "UNSTABLE").when((F.col("status") == "P") & (F.col("value") > 200000), "UNKNOWN").otherwise("PASS")
    return s.stability(matches(spark, sf_dir).withColumn("s", x), ["team_id"], "s")


@query(THIRDS + "select partition, array_to_string(list_sort(list(distinct o_orderstatus)), ',') as states, count(distinct o_custkey) as teams from thirds group by 1")
def partition_members(spark, sf_dir):
    return thirds(spark, sf_dir).groupBy("partition").agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("states"), F.count_distinct("team_id").alias("teams"))

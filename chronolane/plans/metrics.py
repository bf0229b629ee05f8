"""Metric queries on labels with a deterministic score, and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..sources.driver_tables import table
from .registry import query

SCORED = "(select doc_id, toxic as y, quality, [1 - p, p] as p, p as q from (select *, ((doc_id * 37) % 101 + 0.5) / 102 as p from labels))"


def scored(spark, sf_dir):
    q = ((F.col("doc_id") * 37) % 101 + 0.5) / 102
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"), "quality", F.array(1 - q, q).alias("p"), q.alias("q"))


@query(f"select quality, count(*) as n, round(avg(-ln(greatest(p[y + 1], 1e-15))), 6) as log_loss, round(avg(pow(p[1] - (y = 0)::int, 2) + pow(p[2] - (y = 1)::int, 2)), 6) as brier from {SCORED} group by 1")
def logloss_brier(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("quality").agg(F.count("*").alias("n"), F.round(m.log_loss(F.col("p"), F.col("y")), 6).alias("log_loss"), F.round(m.brier(F.col("p"), F.col("y")), 6).alias("brier"))


@query(f"""with r as (select quality, count(*) filter (y = 0) as support_0, count(*) filter (y = 0 and q <= 0.5) / nullif(count(*) filter (y = 0), 0) as recall_0, count(*) filter (y = 1) as support_1, count(*) filter (y = 1 and q > 0.5) / nullif(count(*) filter (y = 1), 0) as recall_1 from {SCORED} group by 1)
select quality, support_0, round(recall_0, 6) as recall_0, support_1, round(recall_1, 6) as recall_1, round((recall_0 + recall_1) / 2, 6) as macro from r""")
def recall(spark, sf_dir):
    r = m.recalls(scored(spark, sf_dir).withColumn("predicted", m.argmax(F.col("p"))), ["quality"], "y", "predicted", 2)
    return r.select("quality", "support_0", F.round("recall_0", 6).alias("recall_0"), "support_1", F.round("recall_1", 6).alias("recall_1"), F.round("macro", 6).alias("macro"))


@query(f"select doc_id, (q > 0.5)::int as predicted, (q > 0.5)::int = y as correct from {SCORED}")
def metric_bundle(spark, sf_dir):
    k = m.argmax(F.col("p"))
    return scored(spark, sf_dir).select("doc_id", k.alias("predicted"), (k == F.col("y")).alias("correct"))


@query(f"""with b as (select *, least(floor(greatest(q, 1 - q) * 10), 9) as bin from {SCORED}) select cast(bin as bigint) as bin, count(*) as n, round(avg(greatest(q, 1 - q)), 6) as confidence, round(avg(((q > 0.5)::int = y)::int), 6) as accuracy from b group by 1""")
def play_metrics(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("confidence", F.array_max("p")).withColumn("correct", m.argmax(F.col("p")) == F.col("y"))
    c = m.calibration_bins(s, [], "confidence", "correct")
    return c.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query("select quality, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as prior from labels group by 1")
def prior_baseline(spark, sf_dir):
    return m.prior(table(spark, sf_dir, "labels"), "quality").select("quality", "n", F.round("prior", 6).alias("prior"))


@query("""with v as (select *, [value / 500, 0.3, 1 - value / 1000] as p from events), z as (select event_id, unnest(p) as p, unnest(['home', 'draw', 'away']) as name from v), r as (select *, row_number() over (partition by event_id order by p desc, name) as k from z)
select event_id, max(name) filter (k = 1) as first, round(max(0.5 + p / 2) filter (k = 1), 6) as confidence, max(name) filter (k = 2) as second from r group by 1""")
def top_two_classes(spark, sf_dir):
    x = F.col("value")
    t = m.top_two(F.array(x / 500, F.lit(0.3), 1 - x / 1000), ["home", "draw", "away"])
    return table(spark, sf_dir, "events").withColumn("t", t).select("event_id", F.col("t")[0]["name"].alias("first"), F.round(F.col("t")[0]["confidence"], 6).alias("confidence"), F.col("t")[1]["name"].alias("second"))


@query("""select p_brand as family, arg_min(p_partkey, row(p_size, p_retailprice, p_partkey)) as candidate from part group by 1""")
def candidate_selection(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("candidate"), "p_size", "p_retailprice")
    return m.best_candidate(p, ["family"], "p_size", "p_retailprice", "candidate").select("family", "candidate")


@query("""with f as (select c_mktsegment, avg(c_acctbal) as mean, stddev_pop(c_acctbal) as sd from customer where c_custkey % 3 != 0 group by 1) select c_custkey, round((c_acctbal - mean) / case when sd = 0 then 1 else sd end, 6) as z from customer c join f on c.c_mktsegment = f.c_mktsegment""")
def standardise(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return m.standardised(c, ["c_mktsegment"], "c_acctbal", F.col("c_custkey") % 3 != 0).select("c_custkey", F.round("z", 6).alias("z"))


@query("""with v as (select p_type, cast(row_number() over (order by p_type) as integer) as code from (select distinct p_type from part where p_partkey % 5 = 0 and p_type != 'ECONOMY')) select p_partkey, coalesce(code, 0) as code from part left join v on part.p_type = v.p_type""")
def encode_category(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return m.encoded(p, "p_type", (F.col("p_partkey") % 5 == 0) & (F.col("p_type") != "ECONOMY")).select("p_partkey", "code")


@query("""with f as (select avg(p_retailprice) as m1, stddev_pop(p_retailprice) as s1, avg(p_size) as m2, stddev_pop(p_size) as s2, p_brand from part where p_partkey % 4 != 0 group by p_brand)
select p_partkey, round((p_retailprice - m1) / case when s1 = 0 then 1 else s1 end, 5) as price_z, round((p_size - m2) / case when s2 = 0 then 1 else s2 end, 5) as size_z from part join f on part.p_brand = f.p_brand""")
def feature_matrix(spark, sf_dir):
    """Train-only fit by engine (brand), applied to all partitions, in a fixed order of columns."""
    p, train = table(spark, sf_dir, "part"), F.col("p_partkey") % 4 != 0
    a = m.standardised(p, ["p_brand"], "p_retailprice", train).withColumnRenamed("z", "price_z")
    b = m.standardised(a, ["p_brand"], "p_size", train).withColumnRenamed("z", "size_z")
    return b.select("p_partkey", F.round("price_z", 5).alias("price_z"), F.round("size_z", 5).alias("size_z"))

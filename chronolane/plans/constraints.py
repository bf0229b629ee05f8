"""Constraint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints as c
from ..operators import graphs as g
from ..operators.lineage import pair_counts
from ..sources.driver_tables import table
from .registry import query


@query("""with e as (select s_suppkey % 60 as k, max(s_nationkey) as v from supplier group by 1), f as (select c_custkey % 90 as k, max(c_nationkey) as v from customer where c_custkey % 4 != 0 group by 1)
select coalesce(e.k, f.k) as k, case when f.k is null then 'MISSING' when e.k is null then 'EXTRA' when e.v is distinct from f.v then 'CHANGED' else 'SAME' end as difference from e full outer join f on e.k = f.k""")
def schema_diff(spark, sf_dir):
    e = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 60).alias("k")).agg(F.max("s_nationkey").alias("v"))
    f = table(spark, sf_dir, "customer").where("c_custkey % 4 != 0").groupBy((F.col("c_custkey") % 90).alias("k")).agg(F.max("c_nationkey").alias("v"))
    return c.differences(e, f, ["k"], ["v"])


@query("""select violation, count(*) as n from (select unnest(list_filter([case when o_orderkey is null then 'NO_PARENT' end, case when l_shipdate < o_orderdate then 'SHIPPED_BEFORE_ORDER' end, case when o_orderstatus = 'P' and l_linestatus = 'F' then 'STATUS_MISMATCH' end, case when l_extendedprice > o_totalprice then 'PRICE_ABOVE_TOTAL' end], lambda x: x is not null)) as violation from lineitem left join orders on l_orderkey = o_orderkey and o_orderkey % 17 != 0) group by 1""")
def lineage_violations(spark, sf_dir):
    x, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderkey % 17 != 0")
    rules = {"NO_PARENT": F.col("o_orderkey").isNull(), "SHIPPED_BEFORE_ORDER": F.col("l_shipdate") < F.col("o_orderdate"), "STATUS_MISMATCH": (F.col("o_orderstatus") == "P") & (F.col("l_linestatus") == "F"), "PRICE_ABOVE_TOTAL": F.col("l_extendedprice") > F.col("o_totalprice")}
    v = c.violations(x.join(o, x.l_orderkey == o.o_orderkey, "left"), "l_orderkey", rules)
    return v.groupBy("violation").agg(F.count("*").alias("n"))


@query("""select l_orderkey as run, l_linenumber as line, l_suppkey as engine from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where s_nationkey is distinct from c_nationkey""")
def engine_membership(spark, sf_dir):
    """Lines whose supplier and customer disagree on the nation."""
    x, s, o, k = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders", "customer"))
    j = x.join(s, x.l_suppkey == s.s_suppkey).join(o, x.l_orderkey == o.o_orderkey).join(k, F.col("o_custkey") == F.col("c_custkey"))
    return j.where(~F.col("s_nationkey").eqNullSafe(F.col("c_nationkey"))).select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("engine"))


@query("""select a.o_custkey as team, count(*) as pairs from (select o_custkey, o_orderdate, o_orderkey from orders where o_orderstatus = 'F') a join (select o_custkey, o_orderdate, o_orderkey from orders where o_orderstatus = 'O') b on a.o_custkey = b.o_custkey and year(a.o_orderdate) = year(b.o_orderdate) group by 1""")
def tier_pairs(spark, sf_dir):
    """Final and open rows of one team and year, paired."""
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    a = o.where("o_orderstatus = 'F'").select("o_custkey", "y")
    b = o.where("o_orderstatus = 'O'").select("o_custkey", "y")
    return pair_counts(a, b, ["o_custkey", "y"]).groupBy(F.col("o_custkey").alias("team")).agg(F.sum("pairs").alias("pairs"))


@query("""select o_orderkey as review from orders join customer on o_custkey = c_custkey where o_orderdate >= timestamp '1998-01-01' and c_mktsegment != 'MACHINERY' and o_orderpriority in ('1-URGENT', '2-HIGH') and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate <= o_orderdate)""")
def review_scope(spark, sf_dir):
    o, k, x = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "lineitem")
    r = o.where("o_orderdate >= timestamp_ntz '1998-01-01' and o_orderpriority in ('1-URGENT', '2-HIGH')").join(k.where("c_mktsegment != 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"))
    return r.join(x, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") <= F.col("o_orderdate")), "left_semi").select(F.col("o_orderkey").alias("review"))


@query("""select o_custkey as family, o_orderpriority as channel, count(*) filter (o_orderstatus = 'O') as active from orders group by all having count(*) filter (o_orderstatus = 'O') > 1""")
def release_uniqueness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderpriority").alias("channel"), "o_orderstatus")
    return c.one_active(o, ["family", "channel"], F.col("o_orderstatus") == "O")


@query("select c_custkey as family from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_custkey is not null)")
def unapproved_families(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("family"))
    return c.without_approval(k, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("family")), ["family"])


@query("""select 'p_name' as field, p_name as value, count(*) as n from part group by 2 having count(*) > 1 union all select 'p_brand', p_brand, count(*) from part group by 2 having count(*) > 1""")
def uniqueness(spark, sf_dir):
    return c.repeated(table(spark, sf_dir, "part"), ["p_name", "p_brand"])


@query("""select n.c_custkey as entry, case when o.c_custkey is null then 'UNKNOWN_ROW' when n.seg is distinct from o.c_mktsegment then 'FROZEN_COLUMN' when n.stamp < o.c_custkey then 'STAMP_BACKWARDS' else 'OK' end as update_state from (select c_custkey, case when c_custkey % 7 = 0 then 'X' else c_mktsegment end as seg, c_custkey - case when c_custkey % 5 = 0 then 1 else 0 end as stamp from customer) n left join (select * from customer where c_custkey % 11 != 0) o on n.c_custkey = o.c_custkey""")
def registry_update(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry"), "c_mktsegment", F.col("c_acctbal").alias("note"), F.col("c_custkey").alias("stamp"))
    new = k.withColumn("c_mktsegment", F.when(F.col("entry") % 7 == 0, "X").otherwise(F.col("c_mktsegment"))).withColumn("note", F.lit(0.0)).withColumn("stamp", F.col("stamp") - F.when(F.col("entry") % 5 == 0, 1).otherwise(0))
    return c.guarded_update(k.where("entry % 11 != 0"), new, "entry", ["note"], "stamp")


@query("""with s as (select user_id, event_id, ts, case event_type when 'signup' then 1 when 'view' then 2 when 'click' then 3 when 'purchase' then 4 end as place from events), l as (select *, lag(place) over (partition by user_id order by ts, event_id) as before from s)
select case when place is null then 'UNKNOWN' when place = before then 'DUPLICATE' when place < before then 'FORWARD_REFERENCE' when place > coalesce(before, 0) + 1 then 'GAP' else 'OK' end as step_state, count(*) as n from l group by 1""")
def history_check(spark, sf_dir):
    known = spark.createDataFrame([("signup", 1), ("view", 2), ("click", 3), ("purchase", 4)], "event_type string, place int")
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return c.ordered_steps(e, known, ["user_id"], "at", "event_type").groupBy("step_state").agg(F.count("*").alias("n"))


@query("""with recursive e as (select c_custkey as node, case when c_nationkey = 24 then -c_custkey when c_mktsegment != 'BUILDING' or c_nationkey >= 12 then c_custkey - 1 - c_nationkey % 3 end as parent from customer), r as (select node, 0 as depth from e where parent is null union all select e.node, r.depth + 1 from e join r on e.parent = r.node)
select e.node, case when r.node is not null then 'REACHED' when p.node is null then 'MISSING_PARENT' else 'BEHIND_A_GAP' end as state from e left join r on e.node = r.node left join e p on e.parent = p.node""")
def dependency_graph(spark, sf_dir):
    from ..operators.revisions import chain_depth

    k, n = F.col("c_custkey"), F.col("c_nationkey")
    parent = F.when(n == 24, -k).when((F.col("c_mktsegment") != "BUILDING") | (n >= 12), k - 1 - n % 3)
    e = table(spark, sf_dir, "customer").select(F.lit(0).alias("k"), k.alias("node"), parent.alias("parent"))
    reached = chain_depth(e, ["k"], "node", "parent").select(F.col("node").alias("r"))
    p = e.select(F.col("node").alias("p"))
    both = e.join(reached, e.node == F.col("r"), "left").join(p, e.parent == F.col("p"), "left")
    return both.select("node", F.when(F.col("r").isNotNull(), "REACHED").when(F.col("p").isNull(), "MISSING_PARENT").otherwise("BEHIND_A_GAP").alias("state"))


@query("select event_type as kind, count(*) as n, count(distinct user_id) as owners from events group by 1")
def catalog_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("owners"))


EDGES = """with recursive o as (select o_orderkey as node from orders), e as (select distinct l_orderkey as node, case when l_partkey % 500 = 7 then 2 * l_orderkey else l_orderkey // (l_linenumber + 1) end as parent from lineitem),
x as (select e.node, e.parent, case when p.node is null then 'PARENT_MISSING' when e.parent >= e.node then 'FORWARD_REFERENCE' else 'OK' end as state from e join o on e.node = o.node left join o p on e.parent = p.node),
k as (select node, parent from x where state != 'PARENT_MISSING'),
"""


def dependencies(spark, sf_dir):
    """Orders depend on those whose key is theirs divided by 2, 3 and so on, and some on a later one: diamonds, gaps and cycles."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderkey").alias("position"))
    k = F.col("l_orderkey")
    parent = F.when(F.col("l_partkey") % 500 == 7, 2 * k).otherwise(F.floor(k / (F.col("l_linenumber") + 1)))
    return o, table(spark, sf_dir, "lineitem").select(k.alias("node"), parent.alias("parent")).distinct()


@query(EDGES + "n as (select 1) select state, count(*) as edges, count(distinct node) as nodes from x group by 1")
def dependency_edges(spark, sf_dir):
    return g.edge_states(*dependencies(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("edges"), F.count_distinct("node").alias("nodes"))


@query(EDGES + """r as (select node, parent as up from k union select r.node, k.parent from r join k on r.up = k.node),
ring as (select distinct node from r where node = up), bad as (select node from ring union select r.node from r join ring on r.up = ring.node),
d as (select node, 0 as level from o where node not in (select node from k) union select k.node, d.level + 1 from d join k on k.parent = d.node where k.node not in (select node from bad))
select o.node, cast(case when bad.node is null then max(level) end as bigint) as level from o left join d on o.node = d.node left join bad on o.node = bad.node group by o.node, bad.node""")
def dependency_levels(spark, sf_dir):
    """The level of each node above all of its parents; null on cycles and behind them."""
    return g.levels(*dependencies(spark, sf_dir))


@query("""with i as (select *, case o_orderstatus when 'F' then 'FROZEN' when 'P' then 'SUPERSEDED' else 'DRAFT' end as status, o_orderstatus != 'O' as immutable, case when o_orderstatus != 'O' then o_orderdate end as frozen_at, o_orderdate + interval 10 day as kickoff_at from orders),
c as (select *, o_orderpriority = '5-LOW' as fresh, o_orderpriority = '4-NOT SPECIFIED' as gone, o_orderpriority = '1-URGENT' as moved, o_orderpriority = '2-HIGH' and status = 'DRAFT' as closing, o_custkey % 4 as how, o_orderkey % 5 != 0 as gate from i),
n as (select *, closing and how > 0 as new_immutable, case when closing and how = 2 then kickoff_at when closing and how = 3 then o_orderdate end as new_frozen_at from c),
s as (select case when fresh then 'INSERT' when gone then 'DELETE' when moved or closing then 'UPDATE' else 'SAME' end as change, case when fresh then null when gone then 'FROZEN_INPUT_DELETE' when not (moved or closing) then null when immutable then 'FROZEN_INPUT_MUTATION' when not gate then 'FROZEN_INPUT_MUTATION_OUTSIDE_GATE' when moved then 'FROZEN_INPUT_IDENTITY_FIELDS_ARE_IMMUTABLE'
when not new_immutable then 'FROZEN_INPUT_STATUS_REQUIRES_IMMUTABLE' when new_frozen_at is null then 'FROZEN_INPUT_IMMUTABLE_REQUIRES_FROZEN_AT' when new_frozen_at >= kickoff_at then 'FROZEN_INPUT_FREEZE_MUST_PRECEDE_KICKOFF' end as refused, case when moved then 'odds' else '' end as touched from n)
select change, refused, touched, count(*) as n from s group by all""")
def frozen_changes(spark, sf_dir):
    """Two images of the orders as frozen inputs: what came, went and changed, and which rule refuses it."""
    status, priority, at = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderdate")
    kickoff, shut = at + F.make_dt_interval(F.lit(10)), status != "O"
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("key"), "o_custkey", priority, F.when(status == "F", "FROZEN").when(status == "P", "SUPERSEDED").otherwise("DRAFT").alias("status"), shut.alias("immutable"), F.when(shut, at).alias("frozen_at"), kickoff.alias("kickoff_at"), F.col("o_totalprice").alias("odds"), at)
    closing, how = (priority == "2-HIGH") & (F.col("status") == "DRAFT"), F.col("o_custkey") % 4
    image = ["key", "status", "immutable", "frozen_at", "kickoff_at", "odds"]
    after = rows.where("o_orderpriority != '4-NOT SPECIFIED'").select(
        "key", F.when(closing, "FROZEN").otherwise(F.col("status")).alias("status"), F.when(closing, how > 0).otherwise(F.col("immutable")).alias("immutable"),
        F.when(closing & (how == 2), F.col("kickoff_at")).when(closing & (how == 3), at).otherwise(F.col("frozen_at")).alias("frozen_at"), "kickoff_at", F.when(priority == "1-URGENT", F.col("odds") + 1).otherwise(F.col("odds")).alias("odds"),
    )
    changes = c.change_set(rows.where("o_orderpriority != '5-LOW'").select(*image), after, ["key"])
    guarded = c.frozen_guard(changes, F.when(F.col("key") % 5 != 0, "FREEZE_GATE"))
    return guarded.groupBy("change", "refused", F.array_join("touched", ",").alias("touched")).agg(F.count("*").alias("n"))


@query("""select case when c_mktsegment = 'BUILDING' then 'INSERT' when c_nationkey = 3 then 'DELETE' when c_nationkey = 4 then 'UPDATE' else 'SAME' end as change, case when c_mktsegment = 'BUILDING' then null when c_nationkey = 3 then 'APPEND_ONLY_DELETE' when c_nationkey = 4 then 'APPEND_ONLY_UPDATE' end as refused, count(*) as n from customer where c_mktsegment != 'BUILDING' or c_nationkey != 3 group by all""")
def append_only_changes(spark, sf_dir):
    """Two images of the customers as an append-only table."""
    k = table(spark, sf_dir, "customer")
    before = k.where("c_mktsegment != 'BUILDING'").select("c_custkey", "c_name", "c_acctbal")
    after = k.where("c_nationkey != 3").select("c_custkey", "c_name", F.when(F.col("c_nationkey") == 4, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return c.append_only(c.change_set(before, after, ["c_custkey"])).groupBy("change", "refused").agg(F.count("*").alias("n"))

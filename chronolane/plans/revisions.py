"""Revision queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import revisions as r
from ..sources.driver_tables import quotes, table
from .registry import query


@query("""with v as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) + case when event_id % 97 = 0 then 1 else 0 end as rev, lag(event_id) over (partition by user_id, event_type order by ts, event_id) as sup from events),
w as (select *, lag(rev) over k as b, lag(event_id) over k as bid from (select *, case when event_id % 89 = 0 then null else sup end as s from v) window k as (partition by user_id, event_type order by rev, event_id))
select case when b is null and rev != 1 then 'MISSING_FIRST' when b is null and s is not null then 'DANGLING' when b is not null and rev != b + 1 then 'GAP' when b is not null and s is distinct from bid then 'WRONG_PARENT' else 'OK' end as revision_state, count(*) as n from w group by 1""")
def next_revision(spark, sf_dir):
    w = Window.partitionBy("provider", "market").orderBy("source_time", "quote_id")
    q = quotes(spark, sf_dir).withColumn("revision", F.row_number().over(w) + F.when(F.col("quote_id") % 97 == 0, 1).otherwise(0))
    q = q.withColumn("supersedes", F.when(F.col("quote_id") % 89 != 0, F.lag("quote_id").over(w)))
    return r.revision_check(q, ["provider", "market"], "revision", "supersedes", "quote_id").groupBy("revision_state").agg(F.count("*").alias("n"))


@query("select o_custkey as team_id, o_orderpriority as fact_type, max(o_orderkey) as fact_id, arg_max(o_totalprice, o_orderkey) as value from orders group by all")
def latest_fact(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("team_id"), F.col("o_orderpriority").alias("fact_type"), F.col("o_orderkey").alias("fact_id"), F.col("o_totalprice").alias("value"))
    return r.current(o, ["team_id", "fact_type"], "fact_id")


@query("""with h as (select event_id, user_id, cast(floor(value / 200) as bigint) as h, ts from events), c as (select *, case when h is not distinct from lag(h) over w then 0 else 1 end as c from h window w as (partition by user_id order by ts, event_id))
select event_id as quote_id, cast(sum(c) over (partition by user_id order by ts, event_id) as bigint) as revision from c""")
def hash_revisions(spark, sf_dir):
    q = quotes(spark, sf_dir).withColumn("content", F.floor(F.col("price") / 200))
    return r.hash_revisions(q, ["provider"], ("source_time", "quote_id"), "content").select("quote_id", "revision")


@query("""with recursive o as (select conv_id, turn, own, row_number() over (partition by conv_id order by turn, own) as i from (select conv_id, turn, sha256(role || coalesce(text, '')) as own from conversations)),
c as (select conv_id, turn, i, cast(null as varchar) as prev_hash, sha256('|' || own) as entry_hash from o where i = 1
union all select o.conv_id, o.turn, o.i, c.entry_hash, sha256(c.entry_hash || '|' || o.own) from o join c on o.conv_id is not distinct from c.conv_id and o.i = c.i + 1) select conv_id, turn, prev_hash, entry_hash from c""")
def audit_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("payload", F.concat("role", F.coalesce("text", F.lit(""))))
    return r.audit_chain(c, ["conv_id"], ["turn", "_own"], "payload").select("conv_id", "turn", "prev_hash", "entry_hash")


CHAIN = """with recursive o as (select conv_id, turn, role || coalesce(text, '') as payload, sha256(role || coalesce(text, '')) as own, row_number() over (partition by conv_id order by turn, sha256(role || coalesce(text, ''))) as i from conversations),
c as (select conv_id, turn, own, payload, i, cast(null as varchar) as prev_hash, sha256('|' || own) as entry_hash from o where i = 1
union all select o.conv_id, o.turn, o.own, o.payload, o.i, c.entry_hash, sha256(c.entry_hash || '|' || o.own) from o join c on o.conv_id is not distinct from c.conv_id and o.i = c.i + 1),
"""


def stored_chain(spark, sf_dir):
    """The turns of each conversation as a chain of entries, some of them altered after they were chained."""
    c = table(spark, sf_dir, "conversations").withColumn("payload", F.concat("role", F.coalesce("text", F.lit(""))))
    c = r.audit_chain(c, ["conv_id"], ["turn", "_own"], "payload").select("conv_id", "turn", "payload", "prev_hash", "entry_hash").withColumn("own", F.sha2("payload", 256))
    forged = F.col("payload").endswith("s.") & (F.col("turn") == 1)
    return c.withColumns({"payload": F.when(F.length("payload") % 10 == 3, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")), "entry_hash": F.when(forged, F.sha2("entry_hash", 256)).otherwise(F.col("entry_hash"))})


@query(CHAIN + """s as (select conv_id, turn, i, prev_hash, case when ends_with(payload, 's.') and turn = 1 then sha256(entry_hash) else entry_hash end as entry_hash, case when length(payload) % 10 = 3 then payload || '!' else payload end as payload from c),
v as (select conv_id, turn, sha256(coalesce(prev_hash, '') || '|' || sha256(payload)) is distinct from entry_hash as e, lag(entry_hash) over (partition by conv_id order by i) is distinct from prev_hash as l from s)
select conv_id, turn, concat_ws(',', case when e then 'ENTRY_MISMATCH' end, case when l then 'LINK_BROKEN' end) as broken from v""")
def chain_verified(spark, sf_dir):
    """Every stored entry checked against its own payload and the entry before it."""
    v = r.verified_chain(stored_chain(spark, sf_dir), ["conv_id"], ["turn", "own"], "payload")
    return v.select("conv_id", "turn", F.array_join("broken", ",").alias("broken"))


TREE = "t0 as (select conv_id, 0 as level, (i - 1) // 4 as block, sha256(string_agg(entry_hash, ',' order by i)) as digest from c group by all)" + "".join(
    f", t{k} as (select conv_id, {k} as level, up as block, sha256(string_agg(digest, ',' order by block)) as digest from (select *, block // 4 as up from t{k - 1}) where conv_id in (select conv_id from t{k - 1} where block > 0) group by conv_id, up)" for k in range(1, 16)
)  # 4^16 turns


@query(CHAIN + TREE + " union all ".join(f" select * from t{k}" for k in range(16)))
def chain_digests(spark, sf_dir):
    """A tree of digests over each conversation's entries, four to a block."""
    c = table(spark, sf_dir, "conversations").withColumn("payload", F.concat("role", F.coalesce("text", F.lit(""))))
    c = r.audit_chain(c, ["conv_id"], ["turn", "_own"], "payload").withColumn("own", F.sha2("payload", 256))
    return r.digest_tree(c, ["conv_id"], ["turn", "own"], fan=4)


@query("""select x.l_returnflag as flag, count(*) as edges, round(avg(case when o_custkey % 7 = x.l_suppkey % 7 then 1.0 else 0.0 end), 6) as pass_rate from lineitem x left join orders on l_orderkey = o_orderkey group by 1""")
def lineage_pass_rate(spark, sf_dir):
    x, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    e = x.join(o, x.l_orderkey == o.o_orderkey, "left").select(F.col("l_returnflag").alias("flag"), (F.col("l_suppkey") % 7).alias("parent_hash"), (F.col("o_custkey") % 7).alias("output_hash"))
    return r.edge_pass_rate(e, ["flag"], "parent_hash", "output_hash").select("flag", "edges", F.round("pass_rate", 6).alias("pass_rate"))


@query("""with recursive e as (select distinct conv_id, turn as node, case when turn > 0 then turn - 1 end as parent from conversations), c as (select conv_id, node, 0 as depth from e where parent is null
union all select e.conv_id, e.node, c.depth + 1 from e join c on e.conv_id = c.conv_id and e.parent = c.node ) select conv_id, max(node) as head, max(depth) as depth, count(*) as reached from c group by 1""")
def supersedes_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent")).distinct()
    return r.chain_depth(c, ["conv_id"], "turn", "parent").groupBy("conv_id").agg(F.max("node").alias("head"), F.max("depth").alias("depth"), F.count("*").alias("reached"))


@query("""with recursive e as (select c_custkey as node, case when c_mktsegment != 'MACHINERY' then c_custkey - c_nationkey end as parent from customer),
c as (select node, 'REACHED' as chain, 0 as depth from e where parent is null union all select node, 'CYCLE', null from e where parent = node union all select node, 'DANGLING', null from e where parent not in (select node from e)
union all select e.node, c.chain, c.depth + 1 from e join c on e.parent = c.node and e.node != e.parent) select node, chain, depth from c""")
def supersedes_states(spark, sf_dir):
    """Chains that end at a root, below a missing record, or nowhere."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_custkey") - F.col("c_nationkey")).alias("parent"))
    return r.chain_states(c, [], "node", "parent")


@query("""select append_state, count(*) as n from (select case when s.o_orderkey is null then 'NEW' when b.v = s.v then 'NOOP' else 'CONFLICT' end as append_state from (select o_orderkey, o_totalprice + case when o_orderkey % 11 = 0 then 1 else 0 end as v from orders) b left join (select o_orderkey, o_totalprice as v from orders where o_orderkey % 3 != 0) s on b.o_orderkey = s.o_orderkey) group by 1""")
def append_conflicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    batch = o.withColumn("v", F.col("v") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0))
    return r.append_state(batch, o.where("o_orderkey % 3 != 0"), "o_orderkey", "v").groupBy("append_state").agg(F.count("*").alias("n"))


@query("select o_custkey as team_id, arg_max(o_orderkey, row(o_orderpriority, o_orderdate, o_orderkey)) as match_id, max(o_orderpriority) as revision from orders where o_orderstatus = 'O' group by 1")
def current_projection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("team_id"), F.col("o_orderkey").alias("match_id"), F.col("o_orderpriority").alias("revision"), "o_orderdate")
    return r.current(o, ["team_id"], "revision", "o_orderdate", "match_id").select("team_id", "match_id", "revision")


@query("select s_nationkey as family, s_suppkey % 3 as version, max(s_suppkey) as entry, arg_max(s_name, s_suppkey) as name from supplier group by all")
def registry_view(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("family"), (F.col("s_suppkey") % 3).alias("version"), F.col("s_suppkey").alias("entry"), F.col("s_name").alias("name"))
    return r.current(s, ["family", "version"], "entry")


@query("""select o_custkey as team_id, count(*) as total, count(*) filter (o_orderstatus = 'F') as done, max(o_orderdate) filter (o_orderstatus = 'F') as last_done from orders group by 1""")
def tier_progress(spark, sf_dir):
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("team_id")).agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.max(F.when(done, F.col("o_orderdate"))).alias("last_done"))


@query("select l_orderkey as match_id, max(greatest(l_shipdate, case when l_returnflag = 'R' then l_shipdate + interval 3 day end, o_orderdate)) as updated_at from lineitem join orders on l_orderkey = o_orderkey group by 1")
def latest_update(spark, sf_dir):
    x, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    three = F.col("l_shipdate") + F.make_dt_interval(F.lit(3))
    moment = F.greatest("l_shipdate", F.when(F.col("l_returnflag") == "R", three), "o_orderdate")
    return x.join(o, x.l_orderkey == o.o_orderkey).groupBy(F.col("l_orderkey").alias("match_id")).agg(F.max(moment).alias("updated_at"))

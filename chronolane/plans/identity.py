"""Identity queries on customers, orders, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.canonical import ascii_alias
from ..operators import identity as i
from ..sources.driver_tables import table
from .registry import query


@query("""with k as (select *, 'M' || (c_custkey // 3) as bk, c_nationkey || '/' || c_mktsegment as sk from customer),
known as (select bk, min(c_custkey) as id, arg_min(sk, c_custkey) as sk from k where c_acctbal > 6000 group by bk), st as (select sk, min(id) as id from known group by sk)
select c_custkey as customer, case when a.id is not null and b.id is not null and a.id != b.id then 'CONFLICT' when a.id is not null then 'BUSINESS_KEY' when b.id is not null then 'STRUCTURAL_KEY' else 'NEW' end as match_state,
case when a.id is not null and b.id is not null and a.id != b.id then null else coalesce(a.id, b.id) end as resolved
from (select c_custkey, case when c_acctbal > 0 then bk end as bk, sk from k) k left join known a on k.bk = a.bk left join st b on k.sk = b.sk""")
def identity_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("business_key", F.concat(F.lit("M"), F.floor(F.col("c_custkey") / 3).cast("string"))).withColumn("structural_key", F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    known = c.where("c_acctbal > 6000").groupBy("business_key").agg(F.min("c_custkey").alias("identity_id"), F.min_by("structural_key", "c_custkey").alias("structural_key"))
    rows = c.withColumn("business_key", F.when(F.col("c_acctbal") > 0, F.col("business_key")))
    return i.resolve(rows, known, ["business_key"], ["structural_key"]).select(F.col("c_custkey").alias("customer"), "match_state", "resolved")


ARRIVALS = """with recursive t as (select c_custkey as q, case when c_acctbal > 0 then concat_ws('-', c_mktsegment, c_nationkey % 5, (c_custkey + c_custkey % 11 // 10) % 3, c_custkey // 400 + c_custkey % 13 // 12) end as b,
    c_mktsegment as competition, c_nationkey % 5 as home, c_custkey % 3 as away, c_custkey // 400 as kickoff, c_custkey % 17 // 16 as zone, c_custkey % 2 as source, concat_ws('/', c_mktsegment, c_nationkey % 5, c_custkey % 3, c_custkey // 400) as s from customer),
e as (select b, s, min(q) as q from t where b is not null group by b, s),
m as (select *, q = min(q) over (partition by b) and q = min(q) over (partition by s) as taken from e
  union all select b, s, q, q = min(q) over (partition by b) and q = min(q) over (partition by s) from (select *, bool_or(taken) over (partition by b) or bool_or(taken) over (partition by s) as gone from m) where not gone),
o as (select m.b, m.s, m.q, struct_pack(competition, home, away, kickoff, zone) as was from m join t on t.q = m.q where taken),
j as (select t.*, struct_pack(competition, home, away, kickoff, zone) as me, coalesce(x.q, y.q) as root, coalesce(x.was, y.was) as was, x.q is not null as own from t left join o x on x.b = t.b and x.q <= t.q left join o y on y.s = t.s and y.q <= t.q),
c as (select *, [k for k in list_distinct([case when me.competition != was.competition then 'COMPETITION_ID_CONFLICT' end, case when me.kickoff != was.kickoff then 'KICKOFF_CONFLICT' end, case when me.zone != was.zone then 'TIMEZONE_CONFLICT' end, case when me.home != was.home or me.away != was.away then 'HOME_AWAY_ORIENTATION_CONFLICT' end]) if k is not null] as codes from j),
a as (select *, case when root is null then 'BLOCKED_MISSING_OFFICIAL_REF' when root = q then 'ROOT_CREATED' when len(codes) > 0 then 'BLOCKED_CONFLICT' when own then 'SOURCE_ALIAS' else 'CROSS_SOURCE_ALIAS' end as act from c),
d as (select b, me, source, min(q) as first, arg_min(root, q) as first_root from a where act not like 'BLOCKED%' group by all)
select a.q as customer, case when d.first < a.q then 'DUPLICATE_NOOP' else act end as action, case when d.first < a.q then first_root else root end as root, case when d.first < a.q then '' else array_to_string(list_sort(codes), ',') end as conflicts
from a left join d on d.b is not distinct from a.b and d.me = a.me and d.source = a.source"""


@query(ARRIVALS)
def identity_arrivals(spark, sf_dir):
    """Customers as observations that arrive one by one: the first ones make identities, later ones join or contradict them."""
    k, whole = F.col("c_custkey"), lambda x: F.floor(x).cast("long")
    c = table(spark, sf_dir, "customer").select(
        k.alias("customer"), F.col("c_mktsegment").alias("competition"), (F.col("c_nationkey") % 5).alias("home"), (k % 3).alias("away"), whole(k / 400).alias("kickoff"), whole(k % 17 / 16).alias("zone"), (k % 2).alias("source"), "c_acctbal",
    )
    number = F.concat_ws("-", "competition", F.col("home").cast("string"), ((F.col("customer") + whole(F.col("customer") % 11 / 10)) % 3).cast("string"), (F.col("kickoff") + whole(F.col("customer") % 13 / 12)).cast("string"))
    c = c.withColumn("official", F.when(F.col("c_acctbal") > 0, number))
    key = ["competition", "home", "away", "kickoff"]
    a = i.arrivals(c, "customer", "official", key, i.COMPARED, ["official", *key, "zone", "source"])
    return a.select("customer", "action", "root", F.array_join(F.array_sort("conflicts"), ",").alias("conflicts"))


FIELDS = ("c_nationkey", "c_mktsegment")


@query("""with k as (select c_custkey % 50 as k, c_custkey, c_nationkey, c_mktsegment from customer), r as (select k, min(c_custkey) as s, arg_min(c_nationkey, c_custkey) as n, arg_min(c_mktsegment, c_custkey) as m from k group by k),
d as (select k.k, c_custkey, unnest(['c_nationkey', 'c_mktsegment']) as field, unnest([n::varchar, m]) as first, unnest([c_nationkey::varchar, c_mktsegment]) as later from k join r on k.k = r.k where c_custkey != s)
select k, c_custkey as seq, field, first, later from d where first is distinct from later""")
def identity_conflicts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("k"), F.col("c_custkey").alias("seq"), *FIELDS)
    return i.conflicts(c, ["k"], "seq", list(FIELDS))


@query("""select o_orderkey as match_id, case when h.c_custkey is null then 'UNKNOWN_MATCH' when alias = regexp_replace(lower(h.c_name), '\\W', '', 'g') then case side when 'HOME' then 'LINKED' else 'ALIAS_SIDE_CONFLICT' end
when alias = 's' || o_custkey then case side when 'AWAY' then 'LINKED' else 'ALIAS_SIDE_CONFLICT' end else 'NO_MATCH' end as link
from (select *, case when o_orderkey % 2 = 0 then 'HOME' else 'AWAY' end as side, case o_orderkey % 3 when 0 then 'customer' || lpad(o_custkey::varchar, 9, '0') when 1 then 's' || o_custkey else 'x' end as alias from orders) o left join customer h on h.c_custkey = o.o_custkey and h.c_custkey % 10 != 0""")
def alias_links(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 10 != 0")
    k = F.col("o_orderkey")
    given = F.when(k % 3 == 0, F.concat(F.lit("Customer #"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).when(k % 3 == 1, F.concat(F.lit("S "), F.col("o_custkey").cast("string"))).otherwise("X")
    rows = o.select(k.alias("match_id"), F.when(k % 2 == 0, "HOME").otherwise("AWAY").alias("side"), ascii_alias(given).alias("alias"))
    names = o.join(c, o.o_custkey == c.c_custkey).select(k.alias("match_id"), ascii_alias("c_name").alias("home_key"), ascii_alias(F.concat(F.lit("s"), F.col("o_custkey").cast("string"))).alias("away_key"))
    return i.alias_links(rows, names, "alias", "side").select("match_id", "link")


@query("select doc_id, case when doc_id != f then f end as duplicate_of from (select doc_id, min(doc_id) over (partition by sha256(text)) as f from documents)")
def dedupe_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return i.duplicates(d, ["key"], "doc_id", "doc_id").select("doc_id", "duplicate_of")


@query("""select o_custkey as team_id, cast(o_orderdate as date) as day, o_orderpriority as profile, o_orderstatus as status, min(o_orderkey) as first_id, count(*) as candidates from orders group by all""")
def candidate_dedupe(spark, sf_dir):
    """Distinct candidates of a four-part content key, first one kept."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("team_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    d = i.duplicates(o, ["team_id", "day", "profile", "status"], "o_orderkey", "o_orderkey")
    return d.groupBy("team_id", "day", "profile", "status").agg(F.min("o_orderkey").alias("first_id"), F.count("*").alias("candidates"))


@query("""select case when a.value = b.value and a.event_type = b.event_type and cast(a.ts as date) = cast(b.ts as date) then 'EXACT_REPLAY' when a.value = b.value and a.k = b.k then 'SAME_CONTENT' when a.k = b.k and a.value != b.value then 'CONFLICTING_CONTENT' else 'DISTINCT' end as relation, count(*) as pairs
from (select *, user_id % 5 as k from events) a join (select *, user_id % 5 as k from events) b on a.event_id < b.event_id group by 1""")
def duplicate_semantics(spark, sf_dir):
    """All pairs of candidates, classified."""
    e = table(spark, sf_dir, "events").where("event_id is not null")
    return i.duplicate_pairs(e.select(F.col("value").alias("content"), F.col("event_type").alias("source"), F.to_date("ts").alias("time"), (F.col("user_id") % 5).alias("key")))


@query("""with k as (select user_id || ':' || event_type as key, cast(floor(value / 100) as bigint) as content, event_id from events), f as (select key, min(event_id) as s, arg_min(content, event_id) as c from k group by key)
select case when event_id = s then 'ACCEPTED' when content = c then 'DUPLICATE_NOOP' else 'KEY_CONFLICT' end as delivery, count(*) as n, min(event_id) as first_id from k join f on k.key = f.key group by 1""")
def idempotency_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.floor(F.col("value") / 100).alias("content"), "event_id")
    return i.deliveries(e, "key", "content", "event_id").groupBy("delivery").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))

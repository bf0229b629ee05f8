"""Intake queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.canonical import composed, entry_path
from ..operators import intake as i
from ..sources.driver_tables import table
from .registry import query


@query("""with links as (select l_orderkey as m, case when l_linenumber % 2 = 0 then 'HOME' else 'AWAY' end as side, arg_max(l_suppkey, row(l_shipdate, l_suppkey)) as linked from lineitem where l_returnflag != 'R' group by all),
r as (select o.o_orderkey, case when x.k = 0 then 'HOME' else 'AWAY' end as side, o.o_custkey % 10 as team, o.o_orderdate + to_days(cast(o.o_orderkey % 40 as integer)) as cutoff, o.o_orderpriority = '5-LOW' as future from orders o, (select unnest([0, 1]) as k) x),
j as (select r.*, case when o_orderkey % 31 != 0 then (select o_orderdate from orders z where z.o_orderkey = r.o_orderkey) + interval 30 day end as kickoff, linked from r left join links on m = o_orderkey and links.side = r.side)
select case when kickoff is null then 'IDENTITY_MISSING' when linked is null then 'LINK_MISSING' when team != linked % 10 then 'TEAM_NOT_ON_SIDE' when cutoff >= kickoff then 'CUTOFF_AFTER_KICKOFF' when future then 'FUTURE_DATA' end as reject, count(*) as n from j group by 1""")
def team_intake(spark, sf_dir):
    x, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    links = x.where("l_returnflag != 'R'").select(F.col("l_orderkey").alias("match_id"), F.when(F.col("l_linenumber") % 2 == 0, "HOME").otherwise("AWAY").alias("side"), F.col("l_suppkey").alias("linked_team"), F.col("l_shipdate").alias("link_at"))
    rows = o.select(F.col("o_orderkey").alias("match_id"), (F.col("o_custkey") % 10).alias("team_id"), (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 40).cast("int"))).alias("cutoff"), (F.col("o_orderpriority") == "5-LOW").alias("future"), F.explode(F.array(F.lit("HOME"), F.lit("AWAY"))).alias("side"), F.col("o_orderkey").alias("observation_id"))
    known = o.where("o_orderkey % 31 != 0").select(F.col("o_orderkey").alias("match_id"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("kickoff"))
    latest = links.groupBy("match_id", "side").agg(F.max_by("linked_team", F.struct("link_at", "linked_team")).alias("linked_team"), F.max("link_at").alias("link_at"))
    return i.team_intake(rows, known, latest.withColumn("linked_team", F.col("linked_team") % 10)).groupBy("reject").agg(F.count("*").alias("n"))


@query("""with r as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) as revision, case when event_id % 6 = 0 then event_id - 7 when event_id % 6 = 1 then -5 when event_id % 6 = 2 then null else lag(event_id) over (partition by user_id, event_type order by ts, event_id) end as s from events)
select case when r.s is null then 'FIRST' when p.event_id is null then 'DANGLING' when p.user_id != r.user_id or p.event_type != r.event_type then 'OTHER_KEY' else 'OK' end as supersedes_state, count(*) as n, cast(max(revision) as integer) as top_revision from r left join events p on r.s = p.event_id group by 1""")
def external_revisions(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    s = F.when(k % 6 == 0, k - 7).when(k % 6 == 1, F.lit(-5)).when(k % 6 != 2, F.lag("event_id").over(w))
    r = i.external_revisions(e.withColumn("s", s), ["user_id", "event_type"], ["ts", "event_id"], "event_id", "s")
    return r.groupBy("supersedes_state").agg(F.count("*").alias("n"), F.max("revision").alias("top_revision"))


@query("""with c as (select user_id, event_type, list(distinct case when value < 60 then '1.5' when value < 110 then 'x' else '2.5' end) filter (value < 150) as cand from events group by all)
select case when user_id % 9 = 0 then 'MARKET_UNAVAILABLE' when event_type = 'error' then 'NOT_PRESENT' when cand is not null and len(cand) > 1 then 'CONFLICT' when cand is null then 'UNRESOLVED' when cand[1] = 'x' then 'AMBIGUOUS' else 'PARSED' end as state, count(*) as cells from c group by 1""")
def cell_traces(spark, sf_dir):
    """Markets by cell inventory, each cell with its readings."""
    v = F.when(F.col("value") < 60, "1.5").when(F.col("value") < 110, "x").otherwise("2.5")
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.collect_set(F.when(F.col("value") < 150, v)).alias("cand"))
    return c.groupBy(i.cell_state(F.col("user_id") % 9 != 0, F.col("event_type") != "error", F.col("cand")).alias("state")).agg(F.count("*").alias("cells"))


@query("""with s as (select l_orderkey, list_sort(list(l_quantity)) as q from lineitem group by 1) select l_orderkey as image, coalesce(len(q) = 2 and abs(q[1] - 10) <= 8 and abs(q[2] - 30) <= 8, false) as fits from s""")
def layout_match(spark, sf_dir):
    """Each order's quantities as the bars of a picture: all of them must be those of the profile."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.collect_list(F.struct("l_quantity"))["l_quantity"].alias("q"))
    return s.select("image", i.layout_match(F.col("q"), F.array(F.lit(30.0), F.lit(10.0)), 8.0).alias("fits"))


@query("""with p as (select n_nationkey as profile, m as market, n_regionkey / 10.0 as l, 0.1 as t, 0.9 as r, 1.0 as b, 2 + n_nationkey % 3 as rows, 3 as columns from nation, (select unnest(['spf', 'total']) as m) x where n_nationkey != 7),
i as (select unnest(['spf', 'spf', 'total', 'total']) as market, unnest(['home', 'away', 'low', 'high']) as label, unnest([0, 1, 1, 3]) as row, unnest([0, 2, 1, 0]) as col),
c as (select c_custkey as cell, c_nationkey as profile, case when c_custkey % 2 = 0 then 'spf' else 'total' end as market, case c_mktsegment when 'BUILDING' then 'home' when 'MACHINERY' then 'low' when 'FURNITURE' then 'high' else 'away' end as label, 400 + c_nationkey as width, 900 as height from customer),
j as (select c.*, case when l is null then 'UNKNOWN_PROFILE' when row is null then 'UNKNOWN_CELL' when row >= rows or col >= columns then 'OUTSIDE_GRID' else 'LOCATED' end as place, round(l + col * ((r - l) / columns), 6) as x0, round(t + row * ((b - t) / rows), 6) as y0, round(l + (col + 1) * ((r - l) / columns), 6) as x1, round(t + (row + 1) * ((b - t) / rows), 6) as y1
from c left join p on c.profile = p.profile and c.market = p.market left join i on c.market = i.market and c.label = i.label)
select cell, place, case when place = 'LOCATED' then x0 end as "left", case when place = 'LOCATED' then y1 end as bottom, case when place = 'LOCATED' then cast(floor(x0 * width) as bigint) end as left_px, case when place = 'LOCATED' then cast(ceil(y1 * height) as bigint) end as bottom_px from j""")
def cell_places(spark, sf_dir):
    """Cells located by declared layouts: each nation is a profile, each customer a cell."""
    n, k = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    profiles = n.where("n_nationkey != 7").select(F.col("n_nationkey").alias("profile"), F.explode(F.array(F.lit("spf"), F.lit("total"))).alias("market"), (F.col("n_regionkey") / 10.0).alias("left"), F.lit(0.1).alias("top"), F.lit(0.9).alias("right"), F.lit(1.0).alias("bottom"), (2 + F.col("n_nationkey") % 3).alias("rows"), F.lit(3).alias("columns"))
    inventory = spark.createDataFrame([("spf", "home", 0, 0), ("spf", "away", 1, 2), ("total", "low", 1, 1), ("total", "high", 3, 0)], "market string, label string, row int, column int")
    label = F.when(F.col("c_mktsegment") == "BUILDING", "home").when(F.col("c_mktsegment") == "MACHINERY", "low").when(F.col("c_mktsegment") == "FURNITURE", "high").otherwise("away")
    cells = k.select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("profile"), F.when(F.col("c_custkey") % 2 == 0, "spf").otherwise("total").alias("market"), label.alias("label"), (400 + F.col("c_nationkey")).alias("width"), F.lit(900).alias("height"))
    return i.located(cells, profiles, inventory).select("cell", "place", "left", "bottom", "left_px", "bottom_px")


@query("""with l as (select user_id as image, row_number() over (partition by user_id order by ts, event_id) as y, value / 500 as dark from events), d as (select image, y, y - row_number() over (partition by image order by y) as run from l where dark >= 0.2)
select image, cast(min(y) as integer) as start, cast(max(y) + 1 as integer) as "end" from d group by image, run having max(y) + 1 - min(y) >= 3""")
def section_bars(spark, sf_dir):
    """Runs of dark lines, where a provider's quotes in time stand for a picture's lines."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("image"), F.row_number().over(w).alias("y"), (F.col("value") / 500).alias("dark"))
    return i.bar_spans(lines, "image", "y", "dark", 0.2, 3)


@query("""with p as (select page_id, nfc_normalize(case page_id % 5 when 0 then url when 1 then regexp_replace(url, '^https?://', '') when 2 then 'a/../' || page_id when 3 then 'dir/' || page_id || '/' else 'e' || chr(769) || '/' || page_id end) as p from pages)
select page_id, p as path, case when p = '' or contains(p, chr(92)) or regexp_matches(p, '^/|^[A-Za-z]:') then 'ENTRY_PATH_INVALID' when regexp_matches(p, '//') or p like '%/' then 'DIRECTORY_ENTRY_FORBIDDEN' when list_has_any(string_split(p, '/'), ['.', '..']) then 'ENTRY_PATH_INVALID' else 'OK' end as state from p""")
def entry_paths(spark, sf_dir):
    """Paths of archive entries: composed, relative, without dots or doubled slashes."""
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    raw = F.when(k == 0, F.col("url")).when(k == 1, F.regexp_replace("url", "^https?://", "")).when(k == 2, F.concat(F.lit("a/../"), n)).when(k == 3, F.concat(F.lit("dir/"), n, F.lit("/"))).otherwise(F.concat(F.lit("e\u0301/"), n))
    return table(spark, sf_dir, "pages").select("page_id", composed(raw).alias("path")).withColumn("state", entry_path("path"))


@query("""with g as (select l_orderkey, list(distinct l_returnflag) filter (l_tax < 0.06) as got from lineitem group by 1)
select array_to_string(list_filter(['A', 'N', 'R'], lambda f: not coalesce(list_contains(got, f), false)), ',') as lacking, count(*) as samples from orders left join g on o_orderkey = l_orderkey group by 1""")
def minimum_eligibility(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_returnflag").alias("feature"), F.when(F.col("l_tax") < 0.06, "AVAILABLE").otherwise("STALE").alias("state"))
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"))
    e = i.minimum_eligibility(s, x, "sample", "feature", "state", ["A", "N", "R"])
    return e.groupBy(F.array_join("lacking", ",").alias("lacking")).agg(F.count("*").alias("samples"))


@query("""with h as (select conv_id, list(role order by turn, role) as h from conversations group by 1) select conv_id, len(h) as steps, case when h = ['user', 'assistant', 'user', 'assistant'] then 'COMPLETE' when len(h) < 4 and h = (['user', 'assistant', 'user', 'assistant'])[1 : len(h)] then 'PREFIX' else 'DIVERGED' end as applied from h""")
def applied_prefix(spark, sf_dir):
    return i.applied_prefix(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", ["user", "assistant", "user", "assistant"])


@query("""with e as (select event_type, value, case when value < 20 then 'UNKNOWN' else 'AVAILABLE' end as given, case when event_id % 20 != 0 then date_trunc('day', ts) end as moment, date_trunc('day', ts) + interval 7 day as expires from events),
s as (select case when event_type = 'error' then 'UNKNOWN_TERM' when moment is null then 'BLOCKED' when moment > timestamp '2024-01-25' then 'FUTURE_DATA' when expires < timestamp '2024-01-25' and given = 'AVAILABLE' then 'STALE' end as gone, * from e)
select coalesce(gone, given) as term_state, expires = timestamp '2024-01-25' as at_end, count(*) as n, count(case when gone is null then value end) as kept from s group by all""")
def tactical_terms(spark, sf_dir):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").withColumns({"given": F.when(F.col("value") < 20, "UNKNOWN").otherwise("AVAILABLE"), "at": F.when(F.col("event_id") % 20 != 0, day), "expires": day + F.make_dt_interval(F.lit(7))})
    terms = e.select("event_type").distinct().where("event_type != 'error'")
    cutoff = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    t = i.tactical(e, terms, "event_type", "value", "given", "at", "expires", cutoff)
    return t.groupBy("term_state", (F.col("expires") == cutoff).alias("at_end")).agg(F.count("*").alias("n"), F.count("value").alias("kept"))


@query("""with a as (select user_id, list_sort(list(distinct event_type)) as s from events where value >= 250 group by 1), b as (select user_id, list_sort(list(distinct event_type)) as s from events where value < 100 group by 1)
select a.user_id as claim, case when b.s is null then 'OPEN' when a.s = b.s then 'COVERED' else 'INCOMPLETE' end as resolution from a left join b on a.user_id = b.user_id""")
def conflict_resolutions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "claim")
    return i.resolution_covers(e.where("value >= 250"), e.where("value < 100"), "claim", "event_type")

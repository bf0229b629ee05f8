"""Market queries on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market as m
from ..sources.driver_tables import observations, quotes, table
from .registry import query

MOVED = """
with q as (select event_id as quote_id, user_id as provider, event_type as market, value as price, ts as source_time,
    lag(value) over s as before, lag(ts) over s as since from events window s as (partition by event_type, user_id order by ts, event_id)),
h as (select *, (epoch_us(source_time) - epoch_us(since)) / 3.6e9 as gap from q),
b as (select *, bool_or(case when since is null then not coalesce(price > 0, false) else not coalesce(gap > 0 and price > 0 and before > 0, false) end) over (partition by market, provider) as blocked from h),
moved as (select *, case when blocked then 'BLOCKED' when since is null then 'FIRST' else 'AVAILABLE' end as state,
    case when not blocked and since is not null then price - before end as delta,
    case when not blocked and since is not null then gap end as hours,
    case when not blocked and since is not null then (price - before) / gap end as velocity from b)
"""


def moved(spark, sf_dir):
    return m.movements(quotes(spark, sf_dir))


@query(MOVED + "select quote_id, provider, market, state, round(delta, 6) as delta, round(hours, 6) as hours, round(velocity, 4) as velocity from moved")
def movement_series(spark, sf_dir):
    return moved(spark, sf_dir).select("quote_id", "provider", "market", "state", F.round("delta", 6).alias("delta"), F.round("hours", 6).alias("hours"), F.round("velocity", 4).alias("velocity"))


@query(MOVED + """select market, provider, quote_id, round(case when abs(a) < 1e9 then a end, 3) as acceleration, case when a is null then 'UNKNOWN' else 'AVAILABLE' end as accel_state
from (select *, (velocity - vb) / hours as a from (select *, lag(velocity) over (partition by market, provider order by source_time, quote_id) as vb,
  row_number() over (partition by market, provider order by source_time desc, quote_id desc) as rn from moved) where rn = 1)""")
def movement_acceleration(spark, sf_dir):
    a = m.accelerations(moved(spark, sf_dir))
    return a.select("market", "provider", "quote_id", F.round(F.when(F.abs("acceleration") < 1e9, F.col("acceleration")), 3).alias("acceleration"), "accel_state")


@query(MOVED + """select market, count(*) as snapshots, count(*) filter (delta != 0) as changes, round(sum(abs(delta)), 4) as abs_delta, count(*) filter (delta > 0) as ups,
count(*) filter (delta < 0) as downs, count(distinct provider) as providers, round((epoch_us(max(source_time)) - epoch_us(min(source_time))) / 3.6e9, 6) as span_hours from moved group by market""")
def market_heat(spark, sf_dir):
    return m.heat(moved(spark, sf_dir)).select("market", "snapshots", "changes", F.round("abs_delta", 4).alias("abs_delta"), "ups", "downs", "providers", F.round("span_hours", 6).alias("span_hours"))


RUNS = MOVED + """, s as (select *, case when delta > 0 then 1 else -1 end as sign from moved where delta != 0),
t as (select *, coalesce(sign != lag(sign) over (partition by market, provider order by source_time, quote_id), false)::int as turned from s),
r as (select *, sum(turned) over (partition by market, provider order by source_time, quote_id) as run from t),
g as (select market, provider, run, sign, count(*) as length from r group by all),
runs as (select market, provider, max(length) as longest, arg_max(sign, row(length, -run)) as direction, max(run) > 0 as reversed from g group by market, provider)
"""


@query(RUNS + "select market, provider, longest, direction, reversed from runs")
def pressure_runs(spark, sf_dir):
    return m.pressure_runs(moved(spark, sf_dir))


FLAGS = MOVED + """, v as (select *, sign(delta) * sign(lag(delta) over (partition by market, provider order by source_time, quote_id)) < 0 as reverses from moved),
f as (select market, provider, count(*) as snapshots, coalesce(bool_or(abs(delta) > 100), false) as jump, coalesce(bool_or(abs(velocity) > 25), false) as fast, coalesce(bool_or(reverses), false) as reversal, bool_or(state = 'BLOCKED') as conflicted from v group by all),
flags as (select *, jump::int + fast::int + reversal::int as flags, case when conflicted then 'CONFLICTED' when snapshots < 3 then 'INSUFFICIENT_DATA' when jump::int + fast::int + reversal::int >= 2 then 'ANOMALOUS' when jump or fast or reversal then 'WATCH' else 'NORMAL' end as risk from f)
"""


@query(FLAGS + "select market, provider, snapshots, jump, fast, reversal, conflicted, flags, risk from flags")
def anomaly_flags(spark, sf_dir):
    return m.anomaly_flags(moved(spark, sf_dir), 100, 25)


@query(RUNS.replace("runs as (", "runs as (") + ", " + FLAGS.split("moved as (", 1)[1].split(" from b)\n", 1)[1].lstrip(", ") + """
select f.market, f.risk, count(*) as series, max(longest) as longest_run, count(*) filter (reversed) as reversed_series from flags f left join runs r on f.market = r.market and f.provider = r.provider group by all""")
def risk_profile(spark, sf_dir):
    q = moved(spark, sf_dir)
    both = m.anomaly_flags(q, 100, 25).join(m.pressure_runs(q), ["market", "provider"], "left")
    return both.groupBy("market", "risk").agg(F.count("*").alias("series"), F.max("longest").alias("longest_run"), F.count_if("reversed").alias("reversed_series"))


@query("""with e as (select * from events where value > 0), l as (select event_type, user_id, arg_max(value, row(ts, event_id)) as price from e group by all),
g as (select event_type, list_sort(list(price)) as a from l group by 1),
h as (select *, len(a) as n, len(a) // 2 as k, list_median_ from (select *, median_ as list_median_ from (select event_type, a, list_aggregate(a, 'median') as median_ from g)))
select h.event_type as market, n::int as eligible, (select count(*) from events x where x.event_type = h.event_type and not coalesce(x.value > 0, false)) as excluded, round(list_median_, 6) as median,
round(case when n < 2 then 0.0 else list_aggregate(a[n - k + 1 : n], 'median') - list_aggregate(a[1 : k], 'median') end, 6) as iqr,
round(list_aggregate(list_transform(a, lambda x: abs(x - list_median_)), 'median'), 6) as mad from h""")
def provider_dispersion(spark, sf_dir):
    d = m.provider_aggregate(quotes(spark, sf_dir))
    return d.select("market", "eligible", "excluded", *(F.round(c, 6).alias(c) for c in ("median", "iqr", "mad")))


@query("""select event_id as quote_id, round(1 / value / sum(1 / value) over w, 8) as implied, round(sum(1 / value) over w, 6) as overround from events where value > 0
window w as (partition by user_id, cast(ts as date))""")
def implied_probability(spark, sf_dir):
    q = quotes(spark, sf_dir).withColumn("snapshot", F.struct("provider", F.to_date("source_time")))
    return m.implied_probability(q, "snapshot").select("quote_id", F.round("implied", 8).alias("implied"), F.round("overround", 6).alias("overround"))


@query("""select event_type as market, user_id as provider, arg_max(event_id, row(ts, event_id)) as quote_id, arg_max(value, row(ts, event_id)) as price, max(ts) as source_time
from events where ts <= timestamp '2024-01-20 00:00:00' and value > 0 group by all""")
def latest_eligible(spark, sf_dir):
    q = quotes(spark, sf_dir).where("source_time <= timestamp_ntz '2024-01-20 00:00:00' and price > 0")
    return m.latest(q.drop("line"), ("market", "provider"), ("source_time", "quote_id")).select("market", "provider", "quote_id", "price", "source_time")


@query("select event_type as market, user_id as provider, max(event_id) as quote_id, arg_max(value, event_id) as price from events group by all")
def latest_inserted(spark, sf_dir):
    """By insertion sequence, whatever the source time says."""
    return m.latest(quotes(spark, sf_dir).select("market", "provider", "quote_id", "price", F.col("quote_id").alias("seq")), ("market", "provider"), ("seq",)).select("market", "provider", "quote_id", "price")


@query("""with i as (select event_type as market, cast(ts as date) as day, user_id, arg_max(value, row(ts, event_id)) as price from events where value > 0 group by all),
p as (select *, 1 / price / sum(1 / price) over (partition by user_id, day) as implied from i)
select a.market, a.day, a.user_id as provider, round(a.implied, 8) as official, round(b.implied - a.implied, 8) as divergence, case when b.implied is null then 'NOT_COMPARABLE' else 'AVAILABLE' end as state
from (select * from p where user_id % 2 = 1) a left join (select * from p where user_id % 2 = 0) b on a.market = b.market and a.day = b.day and b.user_id = a.user_id + 1""")
def official_external_divergence(spark, sf_dir):
    q = quotes(spark, sf_dir).where("price > 0").withColumn("day", F.to_date("source_time"))
    p = m.latest(q.drop("line"), ("market", "day", "provider"), ("source_time", "quote_id"))
    p = m.implied_probability(p.withColumn("snapshot", F.struct("provider", "day")), "snapshot").select("market", "day", "provider", "implied")
    # odd providers are official, and the one after each is the external one it is compared with
    d = m.divergence(p.where("provider % 2 = 1"), p.where("provider % 2 = 0").withColumn("provider", F.col("provider") - 1), ["market", "day", "provider"])
    return d.select("market", "day", "provider", F.round("implied", 8).alias("official"), F.round("divergence", 8).alias("divergence"), "state")


@query("""select o_orderkey as match_id, unnest(['spf', 'spf', 'total']) as market, unnest(['home', 'away', 'all']) as selection,
unnest([o_totalprice, o_totalprice / 2, o_totalprice * 2]) as price from orders""")
def market_normalise(spark, sf_dir):
    p = F.col("o_totalprice")
    nested = F.create_map(F.lit("spf"), F.create_map(F.lit("home"), p, F.lit("away"), p / 2), F.lit("total"), F.create_map(F.lit("all"), p * 2))
    return m.market_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), nested.alias("markets")), ["match_id"])


@query("""select l_orderkey as match_id, case max(case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end) when 2 then 'BLOCKED' when 1 then 'NOT_VERIFIED' else 'PASSED' end as availability from lineitem group by 1""")
def availability_gate(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("market_state", F.when(F.col("flag") == "R", "BLOCKED").when(F.col("flag") == "A", "NOT_VERIFIED").otherwise("PASSED"))
    return m.availability(o, "match_id", "market_state", ("BLOCKED", "NOT_VERIFIED", "PASSED"))

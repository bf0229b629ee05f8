"""Hash and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical as c
from ..sources.driver_tables import table
from .registry import query


@query("select n_nationkey as id, 'sha256:' || sha256(n_nationkey || '|' || n_name) as hash from nation union all select 100 + r_regionkey, 'sha256:' || sha256(r_regionkey || '|' || r_name) from region")
def content_hash(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a = n.select(F.col("n_nationkey").alias("id"), c.sha256_id(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name")).alias("hash"))
    return a.unionByName(r.select((100 + F.col("r_regionkey")).alias("id"), c.sha256_id(F.concat_ws("|", F.col("r_regionkey").cast("string"), "r_name")).alias("hash")))


@query("""select event_id, 'sha256:' || sha256('{"k":' || json_extract_string(props, '$.k') || '}') as hash from events""")
def canonical_json_hash(spark, sf_dir):
    """Keys sorted, no blanks; the one step that needs Python, in Arrow batches."""
    return table(spark, sf_dir, "events").select("event_id", c.sha256_id(c.canonical_json("props")).alias("hash"))


@query("select c_custkey, regexp_replace(lower(c_name), '\\W', '', 'g') as alias from customer")
def alias_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", c.alias_key("c_name").alias("alias"))


@query("""select event_id, case when event_id % 4 = 3 or value <= 0 or value > 400 then null else value end as number from events""")
def printed_numbers(spark, sf_dir):
    x = F.format_string("%.2f", "value")
    t = F.when(F.col("event_id") % 4 == 3, F.concat(x, F.lit("."))).when(F.col("event_id") % 4 == 1, F.replace(x, F.lit("."), F.lit(","))).otherwise(F.concat(F.lit(" "), x))
    n = c.decimal_text(t)
    return table(spark, sf_dir, "events").select("event_id", F.when(n <= 400, n).alias("number"))


@query("""with h as (select c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(sha256(c_name || '|' || c_mktsegment))) as h from customer)
select c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', h[17]), 1) || h[18:20] || '-' || h[21:32] as uuid from h""")
def identity_uuids(spark, sf_dir):
    """Version-5 UUIDs of customers' content hashes."""
    return table(spark, sf_dir, "customer").select("c_custkey", c.name_uuid(F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256)).alias("uuid"))


@query("select event_id, case when event_id % 5 = 0 then '$.a[1].secret' end as path from events")
def forbidden_keys(spark, sf_dir):
    body = F.when(F.col("event_id") % 5 == 0, F.lit('{"a":[1,{"secret":2}]}')).otherwise(F.lit('{"a":[1,{"open":2}]}'))
    return table(spark, sf_dir, "events").select("event_id", c.forbidden_path(("secret", "password"))(body).alias("path"))

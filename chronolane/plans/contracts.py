"""Contracts and lineage over the driver tables.

The driver's columns are laid out as the domain's by expressions that both engines read alike; the
rules themselves are written twice, in `operators` and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import sha256_id
from ..operators import contracts as c
from ..operators import lineage as l
from ..operators import samples as s
from ..sources.driver_tables import table
from .registry import query

ROLES = ("OUTCOME", "HANDICAP", "GOALS", "HTFT")


def laid_out(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*(f"{e} as {n}" for n, e in columns.items()))


def sql(source: str, columns: dict[str, str]) -> str:
    return f"select {', '.join(f'{e} as {n}' for n, e in columns.items())} from {source}"


def listed(*steps: tuple[str, str]) -> str:
    """SQL of all names whose condition holds, joined."""
    return f"array_to_string(list_filter([{', '.join(f'case when {w} then {chr(39)}{n}{chr(39)} end' for w, n in steps)}], lambda x: x is not null), ',')"


SAMPLES = {
    "sample_id": "o_orderkey", "match_id": "o_custkey", "role": "case o_orderpriority when '1-URGENT' then 'OUTCOME' when '2-HIGH' then 'HANDICAP' when '3-MEDIUM' then 'GOALS' when '5-LOW' then 'HTFT' else 'OTHER' end",
    "state": "case o_orderstatus when 'F' then 'ELIGIBLE' when 'O' then 'INELIGIBLE' else 'ODD' end", "sign": "case when o_totalprice > 400000 then 'away_minus_home' when o_totalprice > 100000 then 'home_minus_away' end",
    "line_ref": "case when o_totalprice < 300000 then o_orderkey end", "availability_at": "case when o_totalprice > 20000 then o_orderdate + interval 3 day end",
    "cutoff_at": "case when o_orderstatus = 'P' then o_orderdate + interval 2 day else o_orderdate + interval 5 day end", "kickoff_at": "case when o_totalprice > 450000 then o_orderdate + interval 5 day else o_orderdate + interval 9 day end",
    "label_ref": "case when o_totalprice > 60000 then o_orderkey end", "label_hash": "case when o_totalprice > 350000 then 'sha256:zz' end",
}


@query(f"""with f as ({sql("orders", SAMPLES)}) select {listed(
    ("label_ref is null", "REQUIRED_FIELD_MISSING:label_ref"), ("role = 'OTHER'", "ENGINE_ROLE_INVALID"), ("state = 'ODD'", "ELIGIBILITY_STATE_INVALID"), ("availability_at is null", "AS_OF_TIMESTAMP_INCOMPLETE"),
    ("availability_at is not null and not (availability_at <= cutoff_at and cutoff_at < kickoff_at)", "AS_OF_TIME_PREDICATE_FAILED"), ("label_hash is not null", "HASH_INVALID:label_hash"), ("sign = 'away_minus_home'", "HANDICAP_SIGN_CONVENTION_INVALID"),
    ("role = 'HANDICAP' and line_ref is null", "HANDICAP_BINDING_REQUIRED:line_ref"), ("role = 'HANDICAP' and sign is distinct from 'home_minus_away'", "HANDICAP_SIGN_CONVENTION_REQUIRED"))} as failures, count(*) as n from f group by 1""")
def training_contract(spark, sf_dir):
    """Every failure of a training sample."""
    f = laid_out(table(spark, sf_dir, "orders"), SAMPLES)
    found = c.training_sample(["sample_id", "match_id", "label_ref"], ["label_hash"], ROLES, ("ELIGIBLE", "INELIGIBLE"), ["line_ref"])
    return f.groupBy(F.array_join(found, ",").alias("failures")).agg(F.count("*").alias("n"))


FACTS = {
    "status": "case l_returnflag when 'A' then 'AVAILABLE' when 'R' then 'CONFLICT' when 'N' then case when l_linestatus = 'F' then 'UNKNOWN' else 'NONE' end end", "payload": "case when l_discount > 0.01 then l_discount end",
    "reason": "case when l_tax > 0.06 then 'late news' when l_tax > 0.01 then 'SOURCE_LATE' end", "detail": "case when l_quantity > 25 then 'told' end", "sides": "case when l_quantity > 10 then 2 when l_quantity > 5 then 1 else 0 end",
}


@query(f"""with f as ({sql("lineitem", FACTS)}) select case when status = 'NONE' then 'AVAILABILITY_STATUS_INVALID' when status = 'AVAILABLE' and payload is null then 'PAYLOAD_REQUIRED' when status in ('UNKNOWN', 'CONFLICT') and reason is null then 'REASON_CODE_REQUIRED'
when reason = 'late news' then 'REASON_CODE_INVALID' when detail is not null and reason is null then 'REASON_CODE_REQUIRED' when status = 'CONFLICT' and sides < 2 then 'CONFLICT_EVIDENCE_REQUIRED' when status != 'CONFLICT' and sides > 0 then 'CONFLICT_EVIDENCE_STATUS_MISMATCH' end as error_code, count(*) as n from f group by 1""")
def fact_contract(spark, sf_dir):
    f = laid_out(table(spark, sf_dir, "lineitem"), FACTS)
    return f.groupBy(c.fact("status", "payload", "reason", "detail", "sides").alias("error_code")).agg(F.count("*").alias("n"))


RECORDS = {
    "state": "case l_returnflag when 'A' then 'AVAILABLE' when 'R' then 'STALE' else case when l_tax = 0 then 'GONE' else 'BLOCKED' end end", "value": "case when l_discount > 0 then cast(l_linenumber as varchar(9)) else ' ' end",
    "reason": "case when l_tax > 0.02 then 'EXPIRED' when l_tax > 0.01 then 'lower' end", "detail": "case when l_discount < 0.08 then 'why' end", "linked": "l_quantity > 4", "seen": "l_extendedprice > 30000",
}


@query(f"""with f as ({sql("lineitem", RECORDS)}) select case when state = 'GONE' then 'FEATURE_STATE_INVALID' when state = 'AVAILABLE' and value = ' ' then 'AVAILABLE_VALUE_EMPTY' when state != 'AVAILABLE' and coalesce(reason, 'lower') = 'lower' then 'FEATURE_REASON_REQUIRED'
when state != 'AVAILABLE' and detail is null then 'FEATURE_REASON_DETAIL_REQUIRED' when not linked and not seen then 'FEATURE_PROVENANCE_MISSING' end as error_code, count(*) as n from f group by 1""")
def feature_record_contract(spark, sf_dir):
    refs = lambda n: F.when(F.col(n), F.array(F.lit("r"))).otherwise(F.array().cast("array<string>"))
    f = laid_out(table(spark, sf_dir, "lineitem"), RECORDS).withColumns({"source_refs": refs("linked"), "evidence_refs": refs("seen")})
    return f.groupBy(c.feature_record("state", "value", "reason", "detail", "source_refs", "evidence_refs").alias("error_code")).agg(F.count("*").alias("n"))


@query(f"""with b as (select o_orderkey as bundle_id, o_orderpriority || '|' || cast(o_custkey as varchar) as body, case when o_totalprice > 300000 then ['market', 'form'] else ['form', 'market'] end as categories, o_orderstatus as st from orders)
select case when categories != ['form', 'market'] then 'CATEGORY_ORDER' when st = 'P' then 'HASH_INVALID' when st = 'O' and bundle_id % 5 = 0 then 'BUNDLE_HASH_MISMATCH' else 'OK' end as state, count(*) as n from b group by 1""")
def bundle_contract(spark, sf_dir):
    """Categories in exact order, and the body's hash as stated."""
    o = table(spark, sf_dir, "orders").withColumn("body", F.concat_ws("|", "o_orderpriority", F.col("o_custkey").cast("string")))
    wide = F.col("o_totalprice") > 300000
    o = o.withColumn("categories", F.when(wide, F.array(F.lit("market"), F.lit("form"))).otherwise(F.array(F.lit("form"), F.lit("market"))))
    o = o.withColumn("stated", F.when(F.col("o_orderstatus") == "P", "none").when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 5 == 0), sha256_id(F.lit("x"))).otherwise(sha256_id("body")))
    return o.groupBy(c.bundle("categories", ("form", "market"), "body", "stated").alias("state")).agg(F.count("*").alias("n"))


FROZEN = {
    "status": "case o_orderstatus when 'F' then 'FROZEN' when 'O' then 'SUPERSEDED' else 'DRAFT' end", "immutable": "o_totalprice > 10000", "body": "case when o_totalprice > 480000 then 'V3.3.3 input' else o_orderpriority end",
    "good": "o_totalprice < 350000", "refs": "case when o_totalprice < 50000 then 0 else 2 end", "cutoff_at": "o_orderdate", "kickoff_at": "case when o_totalprice > 450000 then o_orderdate else o_orderdate + interval 1 day end",
}


@query(f"""with f as ({sql("orders", FROZEN)}) select case when status = 'DRAFT' or not immutable then 'FROZEN_INPUT_STATE_INVALID' when status != 'FROZEN' then 'FROZEN_INPUT_NOT_USABLE' when not good and body like '1%' then 'HASH_INVALID' when not good and body like '2%' then 'FROZEN_INPUT_HASH_MISMATCH'
when refs = 0 then 'OFFICIAL_ODDS_REFS_REQUIRED' when cutoff_at >= kickoff_at then 'CUTOFF_AFTER_KICKOFF' when body like 'V3%' then 'V3_ISOLATION_VIOLATION' else 'PASS' end as state, count(*) as n from f group by 1""")
def frozen_inputs(spark, sf_dir):
    f = laid_out(table(spark, sf_dir, "orders"), FROZEN)
    stated = F.when(~F.col("good") & F.col("body").like("1%"), "sha256:").when(~F.col("good") & F.col("body").like("2%"), sha256_id(F.lit("else"))).otherwise(sha256_id("body"))
    f = f.withColumns({"stated": stated, "official": F.array_repeat(F.lit("ref"), F.col("refs"))})
    return f.groupBy(c.frozen_input("status", "immutable", "body", "stated", "official", "cutoff_at", "kickoff_at", formal=True).alias("state")).agg(F.count("*").alias("n"))


ARCHIVED = {
    "availability_at": "case when l_quantity > 2 then l_shipdate end", "cutoff_at": "o_orderdate + interval 60 day", "kickoff_at": "o_orderdate + interval 90 day", "provenance": "case when l_tax = 0 then ' ' else l_returnflag end",
    "broken": "l_discount > 0.08", "record_ref": "case when l_tax < 0.07 then 'r' end", "plain": "l_discount = 0",
}
JOINED = "lineitem join orders on l_orderkey = o_orderkey"


@query(f"""with f as ({sql(JOINED, ARCHIVED)}) select {listed(
    ("availability_at is null", "MISSING_SOURCE_AVAILABILITY_TIMESTAMP"), ("availability_at > cutoff_at", "AS_OF_TIME_PREDICATE_FAILED"), ("provenance = ' '", "MISSING_PROVENANCE"), ("provenance != ' ' and broken", "BROKEN_PROVENANCE_HASH"),
    ("plain", "BROKEN_ARTIFACT_HASH"), ("record_ref is null", "EXACT_ARCHIVE_REF_MISSING"))} as failures, count(*) as n from f group by 1""")
def archive_integrity(spark, sf_dir):
    x, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    f = laid_out(x.join(o, x.l_orderkey == o.o_orderkey), ARCHIVED)
    f = f.withColumns({"stated": F.when(F.col("broken"), sha256_id(F.lit("?"))).otherwise(sha256_id("provenance")), "artifact": F.when(F.col("plain"), "none").otherwise(sha256_id(F.lit("a")))})
    found = c.record_integrity("availability_at", "cutoff_at", "kickoff_at", "provenance", "stated", "artifact", "record_ref", F.lit("m"))
    return f.groupBy(F.array_join(found, ",").alias("failures")).agg(F.count("*").alias("n"))


INTAKE = {
    "home": "l_returnflag", "away": "case when l_quantity > 40 then l_returnflag else l_linestatus end", "rights": "case when l_tax > 0.07 then 'THIRD_PARTY' else 'COMPANY_OWNED' end", "payload": "l_linestatus", "damaged": "l_discount > 0.09",
    "availability_at": "l_shipdate", "cutoff_at": "o_orderdate + interval 100 day", "kickoff_at": "o_orderdate + interval 120 day", "ordered": "case when l_linenumber > 5 then 'UNPROVEN' else 'ORDER_PROVEN' end",
    "proven": "case when l_discount = 0 then 'GUESSED' else 'PROVEN' end", "scored": "l_extendedprice > 90000",
}


@query(f"""with f as ({sql(JOINED, INTAKE)}) select blocker, count(*) as n from (select unnest(string_split({listed(
    ("home = away", "IDENTITY_CONFLICT"), ("rights != 'COMPANY_OWNED'", "RIGHTS_BLOCKED_SOURCE"), ("damaged", "SOURCE_HASH_MISMATCH"), ("not (availability_at <= cutoff_at)", "TEMPORAL_GATE_FAIL"), ("ordered = 'UNPROVEN'", "UNORDERED_REVISION"),
    ("proven = 'GUESSED'", "PROVENANCE_FAIL"), ("scored", "POSTMATCH_FEATURE_LEAK"))}, ',')) as blocker from f) where blocker != '' group by 1""")
def intake_blockers(spark, sf_dir):
    x, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    f = laid_out(x.join(o, x.l_orderkey == o.o_orderkey), INTAKE)
    f = f.withColumns({"stated": F.when(F.col("damaged"), "none").otherwise(sha256_id("payload")), "stages": F.when(F.col("scored"), F.array(F.lit("ODDS"), F.lit("ACTUAL_SCORE"))).otherwise(F.array(F.lit("ODDS")))})
    found = c.intake_blockers("home", "away", "rights", "payload", "stated", "availability_at", "cutoff_at", "kickoff_at", "ordered", "proven", "stages")
    return f.select(F.explode(found).alias("blocker")).groupBy("blocker").agg(F.count("*").alias("n"))


@query("""select case when o_orderstatus = 'F' then 'STORED_ACCEPTED_ARTIFACT' when o_orderstatus = 'O' and o_totalprice > 50000 and o_orderpriority != '5-LOW' and o_totalprice < 400000 then 'DETERMINISTIC_HISTORICAL_REPLAY' else 'NONE' end as path, count(*) as n from orders group by 1""")
def reconstruction_paths(spark, sf_dir):
    proofs = F.array(F.col("o_totalprice") > 50000, F.col("o_orderpriority") != "5-LOW")
    hashes = F.array(F.when(F.col("o_totalprice") >= 400000, "broken"), sha256_id(F.lit("x")))
    p = c.replay_path(F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", proofs, hashes)
    return table(spark, sf_dir, "orders").groupBy(p.alias("path")).agg(F.count("*").alias("n"))


@query("""with a as (select distinct p_type, p_brand from part where p_size > 25) select case when x.p_retailprice > 1700 then 'LATE_FEATURE' when x.p_type = 'PROMO' then 'FEATURE_LEAKAGE_FAIL' when a.p_type is null then 'ENGINE_FEATURE_ISOLATION_FAIL' else 'GRANTED' end as rights, count(*) as n
from part x left join a on x.p_type = a.p_type and x.p_brand = a.p_brand group by 1""")
def engine_feature_rights(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("cutoff", F.lit(1700.0))
    r = c.feature_rights(p, p.where("p_size > 25"), "p_type", "p_brand", "p_retailprice", "cutoff", "^PROMO")
    return r.groupBy("rights").agg(F.count("*").alias("n"))


SEEN = {"alias": "case when c_acctbal < -500 then ' ' else c_name end", "observed": "case when c_mktsegment != 'FURNITURE' then c_acctbal end", "ingested": "case when c_nationkey = 3 then c_acctbal - 1 else c_acctbal + 1 end", "cutoff": "8000.0"}


@query(f"""with f as ({sql("customer", SEEN)}) select case when alias = ' ' then 'ALIAS_EMPTY' when observed is null then 'TIME_MISSING' when ingested < observed then 'INGESTED_BEFORE_OBSERVED' when observed > cutoff then 'FUTURE_DATA' end as error_code, count(*) as n from f group by 1""")
def alias_observations(spark, sf_dir):
    f = laid_out(table(spark, sf_dir, "customer"), SEEN)
    return f.groupBy(c.alias_observation("alias", "observed", "ingested", "cutoff").alias("error_code")).agg(F.count("*").alias("n"))


@query("""with f as (select case when event_type in ('view', 'click') then 'VERIFIED' when event_type = 'error' then 'CONFLICTED' when event_type = 'signup' then 'PENDING' end as status, case when value > 200 then value end as payload, case when value < 100 then 2 when value < 150 then 1 else 0 end as n from events)
select case when status = 'VERIFIED' and (payload is null or n > 0) then 'VERIFIED_SHAPE' when status = 'CONFLICTED' and (n < 2 or payload is not null) then 'CONFLICTED_SHAPE' when status = 'PENDING' and (n > 0 or payload is not null) then 'OTHER_SHAPE' when status is null then 'STATUS_MISSING' else 'OK' end as state, count(*) as n from f group by 1""")
def screenshot_cells(spark, sf_dir):
    v, t = F.col("value"), F.col("event_type")
    e = table(spark, sf_dir, "events").select(F.when(t.isin("view", "click"), "VERIFIED").when(t == "error", "CONFLICTED").when(t == "signup", "PENDING").alias("status"), F.when(v > 200, v).alias("payload"), F.array_repeat(F.lit("c"), F.when(v < 100, 2).when(v < 150, 1).otherwise(0)).alias("candidates"))
    return e.groupBy(c.screenshot_cell("status", "payload", "candidates").alias("state")).agg(F.count("*").alias("n"))


@query("""select case when event_type = 'error' then 'MARKET_KEYS' when value > 300 and event_type = 'view' then 'PAYLOAD_STATE' else 'OK' end as state, count(*) as n from events group by 1""")
def odds_observations(spark, sf_dir):
    """Exactly the declared markets, with prices where the market is available."""
    t, v = F.col("event_type"), F.col("value")
    prices = F.create_map(F.lit("spf"), v, F.when(t == "error", "other").otherwise("total"), F.when(v <= 300, v))
    states = F.create_map(F.lit("spf"), F.lit("AVAILABLE"), F.lit("total"), F.when((v <= 300) | (t == "view"), "AVAILABLE").otherwise("UNAVAILABLE"))
    return table(spark, sf_dir, "events").groupBy(c.odds_observation(prices, ("spf", "total"), states).alias("state")).agg(F.count("*").alias("n"))


@query(f"""select {listed(("l.quality = 0", "BODY_HASH"), ("l.toxic = 1", "CLAIM_HASH"))} as failures, count(*) as n from documents d left join labels l on d.doc_id = l.doc_id group by 1""")
def evidence_items(spark, sf_dir):
    """Three hashes of an evidence item against what they stand for."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    stated = lambda col, bad: F.when(bad, "none").otherwise(sha256_id(F.coalesce(col, F.lit(""))))
    body, source, claim = (F.coalesce(x, F.lit("")) for x in ("text", "source", "lang"))
    found = c.evidence_item(body, stated("text", F.col("quality") == 0), source, stated("source", F.lit(False)), claim, stated("lang", F.col("toxic") == 1))
    return d.groupBy(F.array_join(found, ",").alias("failures")).agg(F.count("*").alias("n"))


# lineage: orders are predictions, customers their inputs, lines what refers to them

PREDICTIONS = {"prediction_id": "o_orderkey", "match_id": "o_custkey", "role": "case o_orderstatus when 'F' then 'PRODUCTION' when 'O' then 'SHADOW' else 'EXPERIMENT' end", "input_id": "o_custkey", "input_hash": "case when o_totalprice > 490000 then 'h?' else 'h' end", "output_hash": "o_orderpriority"}
INPUTS = {"input_id": "c_custkey", "match_id": "case when c_acctbal > 9000 then -1 else c_custkey end", "input_hash": "'h'", "owner_role": "case when c_mktsegment = 'MACHINERY' then 'SHADOW' else 'PRODUCTION' end"}
CUSTOMERS = "(select * from customer where c_mktsegment != 'FURNITURE')"


def predictions(spark, sf_dir):
    return laid_out(table(spark, sf_dir, "orders"), PREDICTIONS)


@query(f"""with p as ({sql("orders", PREDICTIONS)}), i as ({sql(CUSTOMERS, INPUTS)}), f as (select p.*, o_orderdate as frozen_at, case when o_totalprice > 480000 then o_orderdate - interval 1 day else o_orderdate + interval 1 day end as cutoff_at, o_orderdate + interval 2 day as kickoff_at from p join orders on prediction_id = o_orderkey)
select case when i.input_id is null then 'FROZEN_PREDICTION_PARENT_MISSING' when f.match_id != i.match_id or f.input_hash != i.input_hash or not (f.role = i.owner_role or (f.role = 'SHADOW' and i.owner_role = 'PRODUCTION')) or frozen_at > cutoff_at or cutoff_at >= kickoff_at then 'FROZEN_PREDICTION_LINEAGE_INVALID' else 'OK' end as lineage, count(*) as n
from f left join i on f.input_id = i.input_id group by 1""")
def frozen_predictions(spark, sf_dir):
    frozen = {k: PREDICTIONS[k] for k in ("prediction_id", "match_id", "role", "input_id", "input_hash")} | {"frozen_at": "o_orderdate", "cutoff_at": "case when o_totalprice > 480000 then o_orderdate - interval 1 day else o_orderdate + interval 1 day end", "kickoff_at": "o_orderdate + interval 2 day"}
    inputs = laid_out(table(spark, sf_dir, "customer").where("c_mktsegment != 'FURNITURE'"), INPUTS)
    return l.frozen_prediction(laid_out(table(spark, sf_dir, "orders"), frozen), predictions(spark, sf_dir), inputs).groupBy("lineage").agg(F.count("*").alias("n"))


RUNS = {"run_id": "l_orderkey * 10 + l_linenumber", "order_id": "l_orderkey", "role": "case l_linestatus when 'F' then 'PRODUCTION' else 'SHADOW' end"}


@query(f"""with p as ({sql("orders", PREDICTIONS)}), r as (select l_orderkey, l_linenumber, l_linestatus, l_suppkey from lineitem)
select case when l_suppkey % 7 = 0 then 'PREDICTION_ENGINE_PARENT_MISSING' when (case when l_linestatus = 'F' then 'PRODUCTION' else 'SHADOW' end) is distinct from p.role or l_linenumber = 3 then 'PREDICTION_ENGINE_MEMBERSHIP_LINEAGE_INVALID' else 'OK' end as lineage, count(*) as n from r join p on l_orderkey = prediction_id group by 1""")
def engine_members(spark, sf_dir):
    """Predictions and runs that must agree on match, role, input and output."""
    x = table(spark, sf_dir, "lineitem").withColumn("run_id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    p = predictions(spark, sf_dir)
    runs = x.where("l_suppkey % 7 != 0").join(p, x.l_orderkey == p.prediction_id).select("run_id", "match_id", F.when(F.col("l_linestatus") == "F", "PRODUCTION").otherwise("SHADOW").alias("role"), "input_id", "input_hash", "output_hash").dropDuplicates(["run_id"])
    members = x.join(p, x.l_orderkey == p.prediction_id).select("prediction_id", "run_id", F.when(F.col("l_linenumber") == 3, "other").otherwise(F.col("output_hash")).alias("output_hash"))
    return l.engine_membership(members, p, runs).groupBy("lineage").agg(F.count("*").alias("n"))


@query(f"""with p as ({sql("orders", PREDICTIONS)}), d as (select o_custkey, max(o_orderkey) filter (o_orderstatus = 'F') as a, max(o_orderkey) filter (o_orderstatus != 'F') as b, max(o_orderdate) as t from orders group by 1)
select o_custkey as team, case when a is null or b is null then 'TIER_A_PAIR_PARENT_MISSING' when pa.input_hash != pb.input_hash or pb.role != 'SHADOW' then 'TIER_A_SAME_MATCH_SAME_FROZEN_INPUT_PAIR_REQUIRED' when t >= timestamp '1999-06-01' then 'TIER_A_PREMATCH_COMPLETION_REQUIRED' else 'OK' end as lineage
from d left join p pa on a = pa.prediction_id left join p pb on b = pb.prediction_id""")
def tier_pairing(spark, sf_dir):
    """Each team's last production prediction with its last other one."""
    o, final = table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F"
    pairs = o.groupBy(F.col("o_custkey").alias("team")).agg(F.max(F.when(final, F.col("o_orderkey"))).alias("production_id"), F.max(F.when(~final, F.col("o_orderkey"))).alias("shadow_id"), F.max("o_orderdate").alias("production_done_at"))
    pairs = pairs.withColumns({"shadow_done_at": F.col("production_done_at"), "kickoff_at": F.lit("1999-06-01 00:00:00").cast("timestamp_ntz")})
    return l.tier_pair(pairs, predictions(spark, sf_dir)).select("team", "lineage")


@query(f"""with p as ({sql("orders", PREDICTIONS)}) select case when c_custkey is null then 'REVIEW_SCOPE_PARENT_MISSING' when c_acctbal > 9000 or o_orderstatus = 'P' or o_totalprice > 450000 then 'REVIEW_SCOPE_MATCH_ROLE_OR_TIME_INVALID' when o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice > 300000 then 'MODEL_EVALUATION_INPUT_SET_VIOLATION'
when o_orderpriority = '3-MEDIUM' and o_totalprice < 100000 then 'MATCH_EXPLANATION_EVIDENCE_SCOPE_INVALID' when o_orderpriority = '4-NOT SPECIFIED' then 'REVIEW_TYPE_UNKNOWN' else 'OK' end as lineage, count(*) as n from orders left join {CUSTOMERS} on o_custkey = c_custkey group by 1""")
def review_scopes(spark, sf_dir):
    """Reviews against the frozen prediction and the result that they speak of."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "MODEL_EVALUATION").when(F.col("o_orderpriority").isin("3-MEDIUM", "5-LOW"), "MATCH_EXPLANATION")
    refs = F.when(kind == "MATCH_EXPLANATION", F.array_repeat(F.lit("e"), F.when((F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_totalprice") < 100000), 0).otherwise(1)))
    given = F.when(kind == "MODEL_EVALUATION", F.when(F.col("o_totalprice") > 300000, "ALL").otherwise("FROZEN_PREDICTION_RESULT_ONLY")).otherwise("POSTMATCH_EXPLANATION_EVIDENCE")
    day = lambda n: F.col("o_orderdate") + F.make_dt_interval(F.lit(n))
    reviews = o.select(F.col("o_orderkey").alias("frozen_id"), F.col("o_custkey").alias("result_id"), F.col("o_custkey").alias("match_id"), F.when(F.col("o_totalprice") > 450000, F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")).otherwise(day(3)).alias("reviewed_at"), kind.alias("review_type"), given.alias("input_set"), refs.alias("postmatch_refs"))
    frozen = predictions(spark, sf_dir).select(F.col("prediction_id").alias("frozen_id"), "match_id", "role")
    results = table(spark, sf_dir, "customer").where("c_mktsegment != 'FURNITURE'").select(F.col("c_custkey").alias("result_id"), F.when(F.col("c_acctbal") > 9000, -1).otherwise(F.col("c_custkey")).alias("match_id"), F.lit("1992-01-01 00:00:00").cast("timestamp_ntz").alias("verified_at"))
    return l.review_scope(reviews, frozen, results).groupBy("lineage").agg(F.count("*").alias("n"))


@query("""select case when l.doc_id is null then 'PUBLIC_PROJECTION_PARENT_LINEAGE_MISSING' when l.toxic = 1 then 'PUBLIC_PROJECTION_PRODUCTION_ONLY_VIOLATION' when d.n_chars > 20000 then 'PUBLIC_PROJECTION_BUSINESS_TIME_AFTER_KICKOFF' when regexp_matches(lower(d.text), 'password|secret|token') then 'PUBLIC_PROJECTION_SAFE_FIELD_BOUNDARY_VIOLATION' else 'OK' end as lineage, count(*) as n
from documents d left join labels l on d.doc_id = l.doc_id group by 1""")
def public_projections(spark, sf_dir):
    """Published texts with their parents; no text may speak of secrets, anywhere in it."""
    d, k = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.select(F.col("doc_id").alias("model_id"), F.col("doc_id").alias("frozen_id"), F.col("doc_id").alias("match_id"), F.lit(True).alias("published"), F.col("n_chars").alias("business_at"), F.lit(20000).alias("kickoff_at"), "text")
    role = F.when(F.col("toxic") == 1, "SHADOW").otherwise("PRODUCTION").alias("role")
    models = k.select(F.col("doc_id").alias("model_id"), role, F.lit(True).alias("active"))
    frozen = k.select(F.col("doc_id").alias("frozen_id"), F.col("doc_id").alias("match_id"), F.col("doc_id").alias("model_id"), role)
    return l.public_projection(rows, models, frozen, "(?i)password|secret|token", ["text"]).groupBy("lineage").agg(F.count("*").alias("n"))


@query("""select case when o_orderkey is null then 'CONTEXT_EVIDENCE_PARENT_MISSING' when s_suppkey is null then 'CONTEXT_EVIDENCE_PARENT_MISSING' when s_nationkey = 4 then 'CONTEXT_EVIDENCE_TEAM_MISMATCH' when l_tax > 0.07 then 'CONTEXT_EVIDENCE_HASH_MISMATCH' when l_shipdate > o_orderdate + interval 90 day then 'CONTEXT_EVIDENCE_AVAILABILITY_AFTER_CONTEXT_ASOF'
when o_orderstatus = 'P' or s_acctbal < 0 then 'CONTEXT_EVIDENCE_PARENT_NOT_AVAILABLE' else 'OK' end as lineage, count(*) as n from lineitem left join (select * from orders where o_totalprice > 30000) on l_orderkey = o_orderkey left join (select * from supplier where s_acctbal > -500) on l_suppkey = s_suppkey group by 1""")
def context_evidence(spark, sf_dir):
    x, o, e = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_totalprice > 30000"), table(spark, sf_dir, "supplier").where("s_acctbal > -500")
    links = x.select(F.col("l_orderkey").alias("context_id"), F.col("l_suppkey").alias("evidence_id"), F.when(F.col("l_tax") > 0.07, "?").otherwise("h").alias("used_hash"), F.col("l_shipdate").alias("availability_at"))
    contexts = o.select(F.col("o_orderkey").alias("context_id"), F.lit(None).cast("long").alias("match_id"), F.lit(0).alias("team_id"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(90))).alias("as_of_at"), F.when(F.col("o_orderstatus") == "P", "OPEN").otherwise("AVAILABLE").alias("status"))
    evidence = e.select(F.col("s_suppkey").alias("evidence_id"), F.lit(None).cast("long").alias("match_id"), F.when(F.col("s_nationkey") == 4, 1).alias("team_id"), F.lit("h").alias("hash"), F.when(F.col("s_acctbal") < 0, "OPEN").otherwise("AVAILABLE").alias("status"))
    return l.context_evidence(links, contexts, evidence).groupBy("lineage").agg(F.count("*").alias("n"))


# samples and artifacts


@query("""select l_orderkey as match_id, count(*) as features, 'sha256:' || sha256(string_agg(l_returnflag || '|' || l_linestatus, chr(10) order by l_linenumber, l_partkey, l_suppkey, l_returnflag || '|' || l_linestatus)) as artifact_hash from lineitem group by 1""")
def match_artifacts(spark, sf_dir):
    """A match's features in order, under one hash."""
    return s.artifact(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "match_id"), ["match_id"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_returnflag", "l_linestatus"])


@query("""select o_custkey as sample, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) filter (o_orderstatus = 'F') as final, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) filter (o_orderstatus = 'O') as open, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) filter (o_orderstatus = 'P') as pending,
count(*) filter (o_orderstatus = 'F') > 0 and count(*) filter (o_orderstatus = 'O') > 0 and count(*) filter (o_orderstatus = 'P') > 0 as complete from orders group by 1""")
def full_samples(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "sample")
    return s.pivoted(o, "sample", "o_orderstatus", ["F", "O", "P"], "o_totalprice", ["o_orderdate", "o_orderkey"]).select("sample", F.col("F").alias("final"), F.col("O").alias("open"), F.col("P").alias("pending"), "complete")


@query("""select o_custkey as sample, coalesce(arg_max(o_totalprice, row(o_orderdate, o_orderkey)) filter (o_orderstatus = 'F'), -1) as final, coalesce(arg_max(o_totalprice, row(o_orderdate, o_orderkey)) filter (o_orderstatus = 'P'), -1) as pending from orders group by 1""")
def minimum_samples(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "sample")
    return s.pivoted(o, "sample", "o_orderstatus", ["F", "P"], "o_totalprice", ["o_orderdate", "o_orderkey"], F.lit(-1.0)).select("sample", F.col("F").alias("final"), F.col("P").alias("pending"))


@query("""select o_custkey as dataset, o_orderpriority as role, max(o_orderdate) as revision, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) as sample from orders group by all""")
def prior_samples(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_orderpriority").alias("role"), F.col("o_orderdate").alias("revision"), F.col("o_orderkey").alias("sample"))
    return s.prior_sample(o, ["dataset", "role"], "revision", "sample")


@query("""select p_partkey as config, case when (1 + p_size % 3) * (2 + p_size % 2) = 6 then 'OK' else 'BUDGET_MISMATCH' end as grid_state from part""")
def grid_configs(spark, sf_dir):
    """The product of a grid's sizes against the search budget."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("config"), F.array((1 + F.col("p_size") % 3).cast("long"), (2 + F.col("p_size") % 2).cast("long")).alias("sizes"), F.lit(6).alias("budget"))
    return s.grid_budgets(p, F.col("sizes"), "budget").select("config", "grid_state")


@query("""with k as (select unnest(['click', 'view', 'refund']) as kind) select kind, count(event_id) as n from k left join events on event_type = kind group by 1""")
def declared_kinds(spark, sf_dir):
    """Objects of each declared kind, none included."""
    return l.count_by_kind(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind")), "kind", ["click", "view", "refund"])


@query("""select o_custkey as team, count(*) filter (o_orderstatus = 'F') as eligible, count(*) filter (o_orderstatus = 'O') as rejected, count(*) filter (o_orderstatus = 'P') as blocked, max(o_orderkey) filter (o_orderstatus = 'F') as last_eligible, max(o_orderdate) as as_of from orders group by 1""")
def sample_progress(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "ELIGIBLE").when(F.col("o_orderstatus") == "O", "REJECTED").otherwise("BLOCKED")
    o = table(spark, sf_dir, "orders").withColumn("status", status).withColumnRenamed("o_custkey", "team")
    return l.tier_progress(o, ["team"], "status", "o_orderkey", "o_orderdate")


@query("""select case when o_orderkey is null then 'SNAPSHOT_MISSING' when s_suppkey is null then 'GATE_MISSING' when l_shipdate < o_orderdate + interval 5 day then 'TIME_MISMATCH' when s_nationkey is distinct from l_linenumber then 'REF_MISMATCH' else 'CONSISTENT' end as lineage, count(*) as n
from lineitem left join (select * from orders where o_orderstatus != 'P') on l_orderkey = o_orderkey left join (select * from supplier where s_acctbal > 0) on l_suppkey = s_suppkey group by 1""")
def snapshot_references(spark, sf_dir):
    """Snapshot, gate and evidence joined, with the first thing that does not agree."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_suppkey").alias("gate_id"), F.col("l_linenumber").alias("reference"), F.col("l_shipdate").alias("observed_at"))
    snapshots = table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("snapshot_id"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(5))).alias("taken_at"))
    gates = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("gate_id"), F.col("s_nationkey").alias("reference"))
    return l.snapshot_evidence(rows, snapshots, gates).groupBy("lineage").agg(F.count("*").alias("n"))


@query("""select l_orderkey as match_id, max(greatest(l_shipdate, case when l_returnflag = 'R' then l_shipdate + interval 3 day end)) as updated_at from lineitem group by 1""")
def match_updates(spark, sf_dir):
    later = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.make_dt_interval(F.lit(3)))
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_shipdate").alias("captured_at"), later.alias("verified_at"))
    return l.latest_update(x, "match_id", ["captured_at", "verified_at"])


@query("""select o_orderkey as sample_id, o_custkey as match_id, o_orderdate as cutoff_at from orders""")
def sample_order(spark, sf_dir):
    """Samples in their stable order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("match_id"), F.col("o_orderdate").alias("cutoff_at"))
    return s.stable_order(o, "cutoff_at", "match_id", "sample_id")


@query("""select o_orderkey as match_id, round((epoch_us(max(l_shipdate)) - epoch_us(min(o_orderdate))) / 3.6e9, 6) as elapsed_hours, round(max(l_extendedprice) - min(o_totalprice), 4) as delta, 'sha256:' || sha256(o_orderkey || '|' || min(o_custkey)) as movement_id from orders join lineitem on o_orderkey = l_orderkey group by 1""")
def movement_pairs(spark, sf_dir):
    """Elapsed hours, delta and id of a pair: an order and its dearest, latest lines."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end"), F.max("l_extendedprice").alias("after"))
    o = table(spark, sf_dir, "orders").join(x, F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = o.select(F.col("o_orderkey").alias("match_id"), *s.movement_pair("o_totalprice", "after", "o_orderdate", "end", ["o_orderkey", "o_custkey"]))
    return pairs.select("match_id", F.round("elapsed_hours", 6).alias("elapsed_hours"), F.round("delta", 4).alias("delta"), "movement_id")


@query("""with g as (select l_returnflag as partition, count(distinct l_orderkey) as matches, string_agg(distinct l_linestatus, ',' order by l_linestatus) as refs from lineitem group by 1) select *, 'sha256:' || sha256(refs) as refs_hash from g""")
def partition_artifacts(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "partition")
    return s.partition_artifact(x, "partition", "l_orderkey", "l_linestatus")

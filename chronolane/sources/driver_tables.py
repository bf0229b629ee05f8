"""The driver's star schema read as the point-in-time domain.

events are quotes (provider, market, price), orders are matches (team, event time, value), lineitem
holds observations of matches, customer, supplier, nation and region are identities and leagues,
labels are outcomes, documents are evidence, conversations are revision chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quote_id, provider, market, price, source_time, line."""
    e = table(spark, sf_dir, "events")
    line = F.get_json_object("props", "$.k").cast("int").alias("line")
    return e.select(F.col("event_id").alias("quote_id"), F.col("user_id").alias("provider"), F.col("event_type").alias("market"), F.col("value").alias("price"), F.col("ts").alias("source_time"), line)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, team_id, event_time, value, status, priority."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("team_id"), F.col("o_orderdate").alias("event_time"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, line_no, opponent_id, source_id, value, observed_at, side, state."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("source_id"), F.col("l_quantity").alias("value"), F.col("l_shipdate").alias("observed_at"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"))

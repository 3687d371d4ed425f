"""Observations and texts from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_facts(events: DataFrame) -> DataFrame:
    """Observed facts of an event table: seq is the order of arrival."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.concat(F.lit("k_"), (k % 10).cast("string")).alias("object"),
        (F.col("event_type") != "error").alias("polarity"),
        (F.col("value") / (F.col("value") + 10)).alias("confidence"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def order_facts(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("subject"),
        F.concat(F.lit("ordered_"), F.lower("o_orderpriority")).alias("predicate"),
        F.concat(F.lit("status_"), F.col("o_orderstatus")).alias("object"),
        F.lit(True).alias("polarity"),
        (F.col("o_totalprice") / (F.col("o_totalprice") + 100000)).alias("confidence"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


def supply_facts(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("subject"),
        F.lit("supplies").alias("predicate"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("object"),
        (F.col("l_returnflag") != "R").alias("polarity"),
        (F.col("l_quantity") / 50).alias("confidence"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
    )


def geography(region: DataFrame, nation: DataFrame) -> DataFrame:
    """key, type, parent: nations under their regions."""
    top = region.select(F.col("r_name").alias("key"), F.lit("location").alias("type"), F.lit(None).cast("string").alias("parent"))
    below = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("key"), F.lit("location").alias("type"), F.col("r_name").alias("parent"))
    return top.unionByName(below)

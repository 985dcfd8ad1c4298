"""Adapters from the test tables to the canonical event table.

``channel`` is a property of the customer, so it costs a join: each adapter joins the
customer table only when asked. The join is left plain, so that Spark broadcasts the
customers while they are small and sort-merges (with skew splitting) once they are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import to_events


# The layout of the test tables. Naming it spares a job per table to look it up.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double,"
    " props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def user_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's market segment as ``channel``."""
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("channel")
    )


def with_channel(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    return events.join(user_channels(spark, sf_dir), "user_id", "left")


def clickstream_events(
    spark: SparkSession, sf_dir: str, *, channel: bool = False, source: DataFrame | None = None
) -> DataFrame:
    """The ``events`` table; ``platform`` comes from the JSON properties of each row."""
    raw = read_table(spark, sf_dir, "events") if source is None else source
    k = F.get_json_object("props", "$.k").cast("int")
    platform = F.element_at(
        F.array(F.lit("android"), F.lit("ios"), F.lit("web")), (k % 3 + 1).cast("int")
    )
    events = to_events(
        raw, user_id="user_id", event_ts="ts", event_name="event_type", platform=platform
    )
    return with_channel(spark, sf_dir, events) if channel else events


def order_events(spark: SparkSession, sf_dir: str, *, channel: bool = False) -> DataFrame:
    """One event per order, named by its status (O, F or P)."""
    events = to_events(
        read_table(spark, sf_dir, "orders"),
        user_id="o_custkey",
        event_ts="o_orderdate",
        event_name="o_orderstatus",
        platform="o_orderpriority",
    )
    return with_channel(spark, sf_dir, events) if channel else events


def fulfilment_events(spark: SparkSession, sf_dir: str, *, channel: bool = False) -> DataFrame:
    """``order`` per order, ``ship`` per line and ``return`` per returned line."""
    orders = read_table(spark, sf_dir, "orders")
    placed = to_events(
        orders,
        user_id="o_custkey",
        event_ts="o_orderdate",
        event_name=F.lit("order"),
        platform="o_orderpriority",
    )
    lines = read_table(spark, sf_dir, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    names = F.when(
        F.col("l_returnflag") == "R", F.array(F.lit("ship"), F.lit("return"))
    ).otherwise(F.array(F.lit("ship")))
    shipped = to_events(
        lines.withColumn("name", F.explode(names)),
        user_id="o_custkey",
        event_ts="l_shipdate",
        event_name="name",
        platform="o_orderpriority",
    )
    events = placed.unionByName(shipped)
    return with_channel(spark, sf_dir, events) if channel else events

"""Views over the given tables that the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events_txn(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as transactions."""
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("account_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("category"),
        F.col("props").alias("raw_data"),
    )


def orders_txn(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as transactions: whole days only, few per account."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("raw_data"),
    )


def r6(c: str | Column) -> Column:
    """Rounded for comparison; + 0.0 turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def micros(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def joined(c: str | Column) -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, "; ")


TXN = """txn AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS account_id,
         CAST(ts AS TIMESTAMP) AS "timestamp", value AS amount, event_type AS category, props AS raw_data
  FROM events)"""

ORDERS = """txn AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS account_id,
         CAST(o_orderdate AS TIMESTAMP) AS "timestamp", o_totalprice AS amount,
         o_orderpriority AS category, o_orderstatus AS raw_data
  FROM orders)"""

# time features of a transaction
FEATS = """ft AS (
  SELECT *, CAST(hour("timestamp") AS INTEGER) AS hour, CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
         isodow("timestamp") >= 6 AS is_weekend,
         hour("timestamp") BETWEEN 9 AND 17 AS is_business_hours
  FROM txn)"""

"""The driver's tables in the domain's shape, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as appointment events: nation = bureau, customer = person, priority = title, segment = department."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = orders.join(people, orders["o_custkey"] == people["c_custkey"])
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("bureau"), F.col("o_custkey").alias("person"),
        F.when(F.col("o_orderstatus") == "F", "dismiss").otherwise("appoint").alias("action"), F.col("o_orderpriority").alias("title"),
        F.col("c_mktsegment").alias("dept"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


EV = """ev AS (SELECT o_orderkey AS id, c_nationkey AS bureau, o_custkey AS person,
  CASE WHEN o_orderstatus = 'F' THEN 'dismiss' ELSE 'appoint' END AS action, o_orderpriority AS title, c_mktsegment AS dept,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON o_custkey = c_custkey)"""

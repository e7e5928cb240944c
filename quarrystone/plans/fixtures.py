"""Bindings of the operators' inputs to the star schema's tables, once for Spark and once for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cells of each customer, with confidences that follow from its key."""
    c = t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    conf = lambda n: (k * n % 101) / 100.0
    items = F.array(
        F.struct(F.lit("Domain").alias("field"), F.col("c_mktsegment").alias("value"), conf(7).alias("confidence")),
        F.struct(F.lit("Total Variables").alias("field"), F.col("c_nationkey").cast("string").alias("value"), conf(13).alias("confidence")),
        F.struct(F.lit("Frequency").alias("field"), F.when(k % 5 == 0, "[missing]").otherwise("daily").alias("value"), F.when(k % 5 == 0, 0.0).otherwise(conf(29)).alias("confidence")),
    )
    return c.select(F.col("c_name").alias("dataset_name"), F.col("c_nationkey").alias("nation"), F.inline(items))


CELLS = """cells AS (
  SELECT c_name AS dataset_name, c_nationkey AS nation, 'Domain' AS field, c_mktsegment AS value, (c_custkey * 7 % 101) / 100.0 AS confidence FROM customer
  UNION ALL SELECT c_name, c_nationkey, 'Total Variables', CAST(c_nationkey AS VARCHAR), (c_custkey * 13 % 101) / 100.0 FROM customer
  UNION ALL SELECT c_name, c_nationkey, 'Frequency', CASE WHEN c_custkey % 5 = 0 THEN '[missing]' ELSE 'daily' END, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE (c_custkey * 29 % 101) / 100.0 END FROM customer)"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ordered updates of a user's cells, one for each type."""
    e = t(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("dataset_name"), F.col("event_type").alias("field"),
        F.when(F.col("event_id") % 4 == 0, "[missing]").otherwise(F.floor(F.col("value")).cast("string")).alias("value"),
        ((F.col("event_id") * 37 % 97) / 100.0).alias("confidence"), F.col("event_id").alias("ord"),
    )


JOBS = """jobs AS (SELECT 'PROJ_' || (user_id % 40) AS project, CASE event_type WHEN 'click' THEN 'AGENT' WHEN 'view' THEN 'HARVEST' WHEN 'purchase' THEN 'MERGE' WHEN 'error' THEN 'REPAIR' ELSE 'PLAN' END AS mode, ts FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a run of one of 40 projects."""
    e = t(spark, sf_dir, "events")
    mode = F.when(F.col("event_type") == "click", "AGENT").when(F.col("event_type") == "view", "HARVEST").when(F.col("event_type") == "purchase", "MERGE").when(F.col("event_type") == "error", "REPAIR").otherwise("PLAN")
    return e.select(F.concat(F.lit("PROJ_"), (F.col("user_id") % 40).cast("string")).alias("project"), mode.alias("mode"), "ts")

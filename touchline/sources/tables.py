"""The star-schema tables that stand in for tracking data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as series by user: event_id, user_id, event_type, t (seconds) and v (null for errors)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("v"),
    )


#: The same in SQL.
EVENT_SERIES_SQL = """e AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t, CASE WHEN event_type <> 'error' THEN value END AS v FROM events
)"""

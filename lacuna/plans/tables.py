"""Reading the driver's tables for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events on an axis of microseconds: event_id, user_id, event_type, value, us."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


#: The same in DuckDB.
TIMELINE = "tl AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events)"
HOUR, SECOND = 3_600_000_000, 1_000_000

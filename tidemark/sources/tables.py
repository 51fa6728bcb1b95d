"""Readers of the driver's tables as market tables. Only the columns asked for reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp, whole."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trades: symbol, user_id, trade_id, ts (epoch seconds), us (epoch microseconds), price."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "user_id", F.col("event_id").alias("trade_id"), epoch(F.col("ts")).alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("price")
    )

"""Streams: trades without repeats, and candles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trade_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """Trades of a table, as its files arrive: event time ``ts`` as a timestamp. The table is a folder of Parquet files or one file."""
    path = f"{folder}/{name}.parquet"
    there = spark.read.parquet(path)
    reader = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", files_per_trigger)
    files = there.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        reader, path = reader.option("pathGlobFilter", f"{name}.parquet"), folder
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def distinct_trades(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first of each trade within ``delay``; state older than that is dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def distinct_ever(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first of each trade, however late: for back-fills, whose files come in any order. The state keeps every key."""
    return stream.dropDuplicates(keys)


def candle_stream(stream: DataFrame, key: str, price: str, width: str, delay: str = "1 hour") -> DataFrame:
    """Tumbling candles of a stream with a watermark."""
    at = F.struct("ts", price)
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), key)
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume"))
        .select(key, F.unix_timestamp("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its rows, written as Parquet under ``path``: for back-fills and tests."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    rows = f"{path}/rows"
    if mode == "append":
        query = writer.format("parquet").option("path", rows).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows)).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)

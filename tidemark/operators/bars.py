"""Candles: from trades, to longer time frames, closed, with gaps and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ln, quotient


def valid_bar() -> Column:
    """Prices positive, high and low around open and close, volume not negative."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (o > 0) & (c > 0) & (low > 0) & (h >= F.greatest(o, c)) & (low <= F.least(o, c)) & (F.col("volume") >= 0)


def bars_from_trades(trades: DataFrame, tf: int, key: str = "symbol") -> DataFrame:
    """One bar a key and bucket of ``tf`` seconds; trades order by (us, trade_id). Partial aggregates keep hot keys cheap."""
    at = F.struct("us", "trade_id")
    return trades.groupBy(key, (F.col("ts") - F.pmod("ts", F.lit(tf))).alias("ts")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").cast("double").alias("volume")
    )


def resample(bars: DataFrame, source: int, target: int, key: str = "symbol", valid_only: bool = True) -> DataFrame:
    """Longer bars from complete buckets only: every source bar there, once, and valid unless ``valid_only`` is off."""
    full = target // source
    return (
        (bars.where(valid_bar()) if valid_only else bars)
        .groupBy(key, (F.col("ts") - F.pmod("ts", F.lit(target))).alias("ts"))
        .agg(
            F.min_by("open", F.col("ts")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", F.col("ts")).alias("close"), F.sum("volume").alias("volume"),
            F.count("*").alias("_n"), F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.sum("ts").alias("_sum"),
        )
        .where((F.col("_n") == full) & (F.col("_last") - F.col("_first") == target - source) & (F.col("_sum") * 2 == (F.col("_first") + F.col("_last")) * full))
        .drop("_n", "_first", "_last", "_sum")
    )


def closed(bars: DataFrame, tf: int, as_of: int | Column) -> DataFrame:
    """Bars that have ended by ``as_of``, a time or a column."""
    return bars.where(F.col("ts") + tf <= as_of)


def gaps(bars: DataFrame, tf: int, key: str = "symbol") -> DataFrame:
    """Every missing bar between a key's first and last: key, ts."""
    after = F.lead("ts").over(Window.partitionBy(key).orderBy("ts"))
    ends = bars.select(key, "ts").distinct().withColumn("after", after).where(F.col("after") > F.col("ts") + tf)
    return ends.select(key, F.explode(F.sequence(F.col("ts") + tf, F.col("after") - tf, F.lit(tf).cast("long"))).alias("ts"))


def bar_features(bars: DataFrame, key: str = "symbol", valid_only: bool = True) -> DataFrame:
    """Trailing features of each bar: volatility, linear ATR, moving averages, slope, trend strength, volume z-score.

    Windows hold the last 14, 20 or 60 bars, the bar itself included. The first
    bar has no return or true range. Bars that are not valid are left out unless
    ``valid_only`` is off, and a key's first 29 bars have no features yet.
    """
    bars = bars.where(valid_bar()) if valid_only else bars
    order = Window.partitionBy(key).orderBy("ts")
    last = lambda n: order.rowsBetween(1 - n, 0)
    before = F.lag("close").over(order)
    x = bars.withColumn("ret", ln(quotient(F.col("close"), before))).withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    x = x.withColumn("tr", F.when(before.isNotNull(), F.col("tr")))
    sma20, sma60 = F.avg("close").over(last(20)), F.avg("close").over(last(60))
    volume, deviation = F.avg("volume").over(last(60)), F.coalesce(F.stddev_samp("volume").over(last(60)), F.lit(0.0))
    slope = quotient(sma20 - sma60, F.col("close"))
    x = x.withColumn("_n", F.row_number().over(order))
    return x.select(
        "_n", key, "ts", "close", "ret",
        (F.coalesce(F.stddev_samp("ret").over(last(60)), F.lit(0.0)) * F.sqrt(F.lit(60.0))).alias("rv"),
        quotient(F.avg("tr").over(last(14)), F.col("close")).alias("atr_pct"),
        sma20.alias("sma20"), sma60.alias("sma60"), slope.alias("slope"), F.least(F.lit(1.0), 20 * F.abs(slope)).alias("trend_strength"),
        ((F.col("volume") - volume) / (deviation + 1e-9)).alias("volume_z"),
    ).where("_n >= 30").drop("_n")


def regime(features: DataFrame) -> DataFrame:
    """One row over the latest features of all symbols: averages, spread of volatility and trend, agreement, confidence and states.

    ``features`` has atr_pct of hourly bars, trend_strength and spread_bps (null:
    unknown). No symbols give unknown states and confidence 0.
    """
    cv = lambda c: F.coalesce(F.try_divide(F.stddev_pop(c), F.avg(c)), F.lit(0.0))
    x = features.agg(
        F.count("*").alias("n"), F.least(F.count("atr_pct"), F.count("trend_strength")).alias("seen"), F.avg("atr_pct").alias("atr"), F.avg("trend_strength").alias("trend"), F.avg("spread_bps").alias("spread"), cv("atr_pct").alias("cv_atr"), cv("trend_strength").alias("cv_trend")
    )
    n = F.greatest(F.lit(1), F.col("seen"))
    x = x.withColumn("agreement", F.greatest(F.lit(0.0), 1 - 0.5 * F.col("cv_atr") - 0.5 * F.least(F.col("cv_trend"), F.lit(1.0))))
    cap = F.when(n <= 1, 0.40).when(n == 2, 0.52).when(n == 3, 0.64).when(n == 4, 0.75).otherwise(0.85)
    sample = F.least(F.lit(1.0), (n - 1) / 5)
    confidence = F.least(cap, F.greatest(F.lit(0.20), 0.25 + 0.40 * F.col("agreement") + 0.20 * sample))
    none, spread = F.col("n") == 0, F.col("spread")
    vol = F.when(none, "unknown").when(F.col("atr") < 0.02, "low").when(F.col("atr") < 0.06, "normal").otherwise("high")
    trend = F.when(none, "unknown").when(F.col("trend") > 0.6, "trending").when(F.col("trend") < 0.35, "ranging").otherwise("mixed")
    risk = F.when(none, "unknown").when((vol == "high") & F.coalesce(spread > 8, F.lit(False)), "risk_off").when(vol.isin("low", "normal") & F.coalesce(spread < 6, F.lit(True)), "risk_on").otherwise("neutral")
    return x.withColumn("confidence", F.when(none, 0.0).otherwise(confidence)).withColumn("vol_state", vol).withColumn("trend_state", trend).withColumn("risk_state", risk)

"""Order-dependent indicators, folded in the JVM over a bounded tail of each key's bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.direction import vote
from ..functions.numeric import clamp, ln, quotient


#: Bars read of frames up to an hour, of longer ones, and closed bars that a frame needs to vote.
SHORT_TAIL, LONG_TAIL, LEAST_BARS = 260, 420, 80


def frame_votes(bars: DataFrame, now: int | Column, key: str = "symbol") -> DataFrame:
    """The vote of each key's time frames: key, frame, n, slope, atr, hist, rsi, pb, score, trend_strength.

    ``bars`` has key, frame (seconds), ts, high, low, close. Of a frame's last
    bars (SHORT_TAIL, or LONG_TAIL above an hour) those closed by ``now`` count; a
    frame with fewer than LEAST_BARS of them has no vote. Indicators are of log
    prices: slope of means, true range, MACD, Wilder's index, band position.
    """
    read = Window.partitionBy(key, "frame").orderBy(F.col("ts").desc())
    most = F.when(F.col("frame") > 3600, LONG_TAIL).otherwise(SHORT_TAIL)
    tail = bars.withColumn("_k", F.row_number().over(read)).where((F.col("_k") <= most) & (F.col("ts") + F.col("frame") <= now))
    order = Window.partitionBy(key, "frame").orderBy("ts")
    newest = lambda n: F.col("_nth") <= n
    x = tail.withColumn("_nth", F.row_number().over(read)).withColumn("lc", ln(F.col("close"))).withColumn("_before", F.lag("lc").over(order))
    x = x.withColumn("tr", F.greatest(ln(F.col("high")) - ln(F.col("low")), F.abs(ln(F.col("high")) - F.col("_before")), F.abs(ln(F.col("low")) - F.col("_before"))))
    mean = lambda c, n: F.avg(F.when(newest(n), F.col(c)))
    series = F.transform(F.array_sort(F.collect_list(F.struct("ts", "close"))), lambda b: b["close"])
    ends = x.groupBy(key, "frame").agg(
        F.count("*").alias("n"), (mean("lc", 20) - mean("lc", 60)).alias("slope"), mean("tr", 14).alias("atr"), series.alias("xs"), F.max(F.when(newest(1), F.col("lc"))).alias("_last"), mean("lc", 20).alias("_mean"), F.stddev_pop(F.when(newest(20), F.col("lc"))).alias("_sd")
    ).where(F.col("n") >= LEAST_BARS)
    band = clamp((F.col("_last") - F.col("_mean") + 2 * F.col("_sd")) / F.greatest(F.lit(1e-9), 4 * F.col("_sd")))
    ends = ends.withColumn("hist", macd_hist(F.col("xs"))).withColumn("rsi", rsi(F.col("xs"))).withColumn("pb", band)
    said = vote(*[F.col(c) for c in ("slope", "atr", "hist", "rsi", "pb")])
    return ends.select(key, "frame", "n", "slope", "atr", "hist", "rsi", "pb", said["score"].alias("score"), said["trend_strength"].alias("trend_strength"))


def tails(bars: DataFrame, key: str, n: int = 260, value: str = "close") -> DataFrame:
    """key, xs: the last ``n`` values in order of ts. Rows beyond them are dropped before any are collected."""
    newest = Window.partitionBy(key).orderBy(F.col("ts").desc())
    kept = bars.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", value))), lambda x: x[value]).alias("xs"))


def ema(xs: Column, period: int) -> Column:
    """Exponential mean of an array, seeded with its first value."""
    a = 2.0 / (period + 1)
    return F.aggregate(F.slice(xs, 2, 10_000), xs[0], lambda m, x: m + a * (x - m))


def ema_series(xs: Column, period: int) -> Column:
    """The running exponential means of an array."""
    a = 2.0 / (period + 1)
    grow = lambda m, x: F.concat(m, F.array(F.element_at(m, -1) * (1 - a) + x * a))
    return F.aggregate(F.slice(xs, 2, 10_000), F.slice(xs, 1, 1), grow)


def rsi(xs: Column, period: int = 14) -> Column:
    """Wilder's index of an array's log changes: 50 if it is short (under ``period`` + 2 values) or flat, 100 with gains and no losses."""
    n = F.size(xs)
    deltas = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: ln(F.try_element_at(xs, i)) - ln(F.try_element_at(xs, i - 1)))
    smooth = lambda part: F.aggregate(
        F.slice(part, period + 1, 10_000), F.aggregate(F.slice(part, 1, period), F.lit(0.0), lambda s, x: s + x) / period, lambda m, x: (m * (period - 1) + x) / period
    )
    up, down = smooth(F.transform(deltas, lambda d: F.greatest(d, F.lit(0.0)))), smooth(F.transform(deltas, lambda d: F.greatest(-d, F.lit(0.0))))
    return F.when(n < period + 2, 50.0).when((down == 0) & (up == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))


def macd_hist(xs: Column) -> Column:
    """MACD(12, 26) less its own 9-period mean, of log values; 0 for fewer than 35."""
    logs = F.transform(xs, ln)
    line = F.zip_with(ema_series(logs, 12), ema_series(logs, 26), lambda a, b: a - b)
    return F.when(F.size(xs) < 35, 0.0).otherwise(F.element_at(line, -1) - ema(line, 9))


def mean_reversion(bars: DataFrame, key: str = "symbol", returns: int = 160) -> DataFrame:
    """Lag-1 correlation, variance ratio over 4 and share of sign reversals of the last returns, and their weighted score."""
    order, newest = Window.partitionBy(key).orderBy("ts"), Window.partitionBy(key).orderBy(F.col("ts").desc())
    x = bars.withColumn("r", ln(quotient(F.col("close"), F.lag("close").over(order)))).where("r is not null").withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= returns)
    x = x.withColumn("p", F.lag("r").over(order)).withColumn("q", F.when(F.count("r").over(order.rowsBetween(-3, 0)) == 4, F.sum("r").over(order.rowsBetween(-3, 0))))
    flip = F.when((F.col("r") != 0) & (F.col("p") != 0), (F.signum("r") != F.signum("p")).cast("double"))
    got = x.groupBy(key).agg(F.count("*").alias("n"), F.corr("r", "p").alias("corr"), F.try_divide(F.var_samp("q"), 4 * F.var_samp("r")).alias("vr"), F.avg(flip).alias("reversals"))
    part = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    return got.where(F.col("n") >= 41).withColumn("score", 0.45 * part((-F.col("corr") - 0.02) / 0.45) + 0.35 * part((0.98 - F.col("vr")) / 0.50) + 0.20 * part((F.col("reversals") - 0.52) / 0.28))

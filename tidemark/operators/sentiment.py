"""Sentiment of the market and of symbols, from points and from sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, finite

WEEK = 7 * 86400

#: Weight of each source in a symbol's blend.
SOURCE_WEIGHTS = {"momentum": 0.45, "reddit": 0.30, "rss": 0.15, "trending": 0.10}


def point_weight(volume: Column) -> Column:
    """Square root of the volume (1 at least, and if missing), 4 at most."""
    return F.least(F.lit(4.0), F.sqrt(F.greatest(F.lit(1.0), F.coalesce(finite(volume), F.lit(1.0)))))


def recent_points(points: DataFrame, now: Column, span: int) -> DataFrame:
    """Points (ts, sentiment, volume) of the last ``span`` seconds with a finite sentiment, cut to -1..1, and a volume of 0 at least (missing: 0)."""
    sentiment, volume = finite(F.col("sentiment")), F.greatest(F.lit(0), F.coalesce(F.col("volume"), F.lit(0)))
    return points.where(sentiment.isNotNull() & (F.col("ts") >= now - span)).withColumns({"sentiment": clamp(sentiment, -1.0, 1.0), "volume": volume})


def decayed(value: Column, weight: Column, age: Column, half_life: float) -> Column:
    """Aggregate: mean by weight and age, half as much for each half life; 0 without weight."""
    w = weight * F.exp(-F.ln(F.lit(2.0)) / half_life * F.greatest(F.lit(0), age))
    return F.coalesce(F.try_divide(F.sum(w * value), F.sum(w)), F.lit(0.0))


def market_sentiment(points: DataFrame, key: str, now: Column) -> DataFrame:
    """One row a key of points (ts, sentiment, volume): means of four half lives, impulse, effective score, votes, regime, strength, panic and euphoria.

    ``now`` is a column of the points. Points of the last seven days count, each
    within -1 and 1, so that no outlier outweighs the rest. A regime that ties goes to the vote of the
    effective score, then to that of six hours, then to neutral.
    """
    good = recent_points(points.withColumn("_now", now), F.col("_now"), WEEK)
    age, w = F.col("_now") - F.col("ts"), point_weight(F.col("volume"))
    lives = {"s_1h": 3600.0, "s_6h": 21600.0, "s_1d": 86400.0, "s_7d": 604800.0}
    x = good.groupBy(key).agg(F.count("*").alias("n_points"), *[decayed(F.col("sentiment"), w, age, life).alias(name) for name, life in lives.items()])
    x = x.withColumn("impulse", F.col("s_1h") - F.col("s_6h"))
    x = x.withColumn("effective", clamp(0.50 * F.col("s_1h") + 0.30 * F.col("s_6h") + 0.15 * F.col("s_1d") + 0.05 * F.col("s_7d") + 0.20 * F.col("impulse"), -1.0, 1.0))
    said = lambda c: F.when(F.col(c) <= -0.35, "risk_off").when(F.col(c) >= 0.35, "risk_on").otherwise("neutral")
    weights = {"s_1h": 1.30, "s_6h": 1.45, "s_1d": 1.00, "s_7d": 0.60, "effective": 1.35}
    for name in ("risk_on", "risk_off", "neutral"):
        x = x.withColumn(name, sum((F.when(said(c) == name, w_).otherwise(0.0) for c, w_ in weights.items()), F.lit(0.0)))
    rank = lambda name: F.struct(F.round(F.col(name), 6).alias("w"), (said("effective") == name).alias("e"), (said("s_6h") == name).alias("six"), F.lit(name == "neutral").alias("n"), F.lit(name).alias("name"))
    sums = F.reverse(F.array_sort(F.array("risk_on", "risk_off", "neutral")))
    return x.withColumn("regime", F.greatest(*[rank(name) for name in ("risk_on", "risk_off", "neutral")])["name"]).withColumn("strength", clamp((sums[0] - sums[1]) / (F.col("risk_on") + F.col("risk_off") + F.col("neutral")))).withColumn(
        "panic", ((F.col("effective") <= -0.62) & (F.col("impulse") < -0.08)) | (F.col("s_6h") <= -0.60)
    ).withColumn("euphoria", ((F.col("effective") >= 0.62) & (F.col("impulse") > 0.08)) | (F.col("s_6h") >= 0.60))


def symbol_sentiment(points: DataFrame, key: str, now: Column, horizon: int = 21600) -> DataFrame:
    """Effective sentiment of each key from points (ts, sentiment, volume): key, effective, n_points.

    Points of a quarter hour make one, at its last time and of weight 3 at most,
    so that many polls are not many observations; then means of 45 minutes, two
    hours and the horizon, and an impulse. ``now`` is a column of the points.
    """
    good = points.withColumn("_now", now).where(finite(F.col("sentiment")).isNotNull() & (F.col("ts") >= F.col("_now") - horizon))
    w = point_weight(F.col("volume"))
    slices = good.groupBy(key, F.floor(F.col("ts") / 900).alias("_slice")).agg((F.sum(w * clamp(F.col("sentiment"), -1.0, 1.0)) / F.sum(w)).alias("s"), F.least(F.lit(3.0), F.sum(w)).alias("w"), F.max("ts").alias("at"), F.max("_now").alias("_now"))
    mean = lambda life: decayed(F.col("s"), F.col("w"), F.col("_now") - F.col("at"), life)
    x = slices.groupBy(key).agg(F.count("*").alias("n_points"), mean(2700.0).alias("fast"), mean(7200.0).alias("mid"), mean(float(max(3600, horizon))).alias("slow"))
    return x.select(key, clamp(0.60 * F.col("fast") + 0.25 * F.col("mid") + 0.15 * F.col("slow") + 0.30 * (F.col("fast") - F.col("mid")), -1.0, 1.0).alias("effective"), "n_points")


def blended(points: DataFrame, key: str) -> DataFrame:
    """Each key's sources (source, sentiment) as one: mean of each source, by the sources' weights; key, sentiment, n_sources."""
    weight = F.coalesce(*[F.when(F.col("source") == name, F.lit(w)) for name, w in SOURCE_WEIGHTS.items()])
    own = points.where(finite(F.col("sentiment")).isNotNull() & F.col("source").isin(*SOURCE_WEIGHTS)).groupBy(key, "source").agg(F.avg("sentiment").alias("s"))
    return own.groupBy(key).agg(clamp(F.sum(F.col("s") * weight) / F.sum(weight), -1.0, 1.0).alias("sentiment"), F.count("*").alias("n_sources"))


def combined(points: DataFrame, key: str, least_weight: float = 6.0) -> DataFrame:
    """Points of each key as one, by their volume, ``least_weight`` at least: key, sentiment, volume."""
    w = F.greatest(F.coalesce(finite(F.col("volume")), F.lit(1.0)), F.lit(least_weight))
    x = points.where(finite(F.col("sentiment")).isNotNull()).groupBy(key).agg(F.sum(w * F.col("sentiment")).alias("s"), F.sum(w).alias("w"))
    return x.select(key, clamp(F.col("s") / F.col("w"), -1.0, 1.0).alias("sentiment"), F.floor("w").alias("volume"))


def momentum_pulse(points: DataFrame, key: str) -> DataFrame:
    """The market's pulse from symbols (sentiment, volume), by the root of their volume within bounds: key, sentiment, n_symbols."""
    volume = F.greatest(F.lit(1.0), F.coalesce(finite(F.col("volume")), F.lit(1.0)))
    w = clamp(F.sqrt(F.least(volume, F.lit(5e9))) / 5000, 0.8, 6.0)
    x = points.where(finite(F.col("sentiment")).isNotNull()).groupBy(key).agg((F.sum(F.col("sentiment") * w) / F.sum(w)).alias("s"), F.count("*").alias("n_symbols"))
    return x.select(key, clamp(F.col("s"), -1.0, 1.0).alias("sentiment"), "n_symbols")

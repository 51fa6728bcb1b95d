"""Student-t intervals and validation blocks in time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved
from .buckets import running

#: Distinct decision times that the last block needs, and the most blocks.
LAST_TIMES, MOST_BLOCKS = 5, 5

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def t_critical(confidence: np.ndarray, effective: np.ndarray) -> np.ndarray:
    """One-sided critical values of Student's t at ``effective`` - 1 degrees (1 at least); infinite outside 0.5 to 1 or under two effective samples.

    With t = sqrt(df) tan(a) the distribution is an integral of cos(a)**(df - 1),
    smooth on a bounded range: Gauss-Legendre sums, halved until they fit.
    """
    ok = (confidence > 0.5) & (confidence < 1) & (effective >= 2)
    df = np.maximum(1.0, np.where(ok, effective, 2.0) - 1)
    scale = np.exp(np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in df])) / math.sqrt(math.pi)
    low, high = np.zeros(len(df)), np.full(len(df), math.pi / 2)
    for _ in range(60):
        mid = (low + high) / 2
        angles = mid[:, None] * (_NODES + 1) / 2
        below = 0.5 + scale * mid / 2 * (np.cos(angles) ** (df[:, None] - 1) @ _WEIGHTS)
        less = below < confidence
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return np.where(ok, np.sqrt(df) * np.tan((low + high) / 2), np.inf)


def t_critical_column(confidence: Column, effective: Column) -> Column:
    """:func:`t_critical` of columns; null inputs give infinity."""

    def values(c: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(t_critical(c.fillna(0).to_numpy(float), n.fillna(0).to_numpy(float)))

    return F.pandas_udf(values, "double")(confidence, effective)


def mean_interval(mean: Column, std: Column, effective: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Two-sided interval of a weighted mean; nulls unless more than one effective sample and a deviation of zero or more are there."""
    margin = t_critical_column(F.lit((1 + confidence) / 2), effective) * std / F.sqrt(effective)
    ok = (effective > 1) & (std >= 0) & mean.isNotNull() & (margin < float("inf"))
    return F.when(ok, mean - margin), F.when(ok, mean + margin)


def lower_bound(mean: Column, std: Column, effective: Column, confidence: float = 0.95) -> Column:
    """One-sided lower bound of a weighted mean."""
    margin = t_critical_column(F.lit(confidence), effective) * std / F.sqrt(effective)
    return F.when((effective >= 2) & (margin < float("inf")), mean - margin)


def validation_blocks(df: DataFrame, key: str, ts: str, least: int, bucket: int = 30 * 86400) -> DataFrame:
    """Chronological blocks of each key on whole times: key, block, first_ts, last_ts, n, n_times.

    The last block holds ``least`` rows and LAST_TIMES times at least, and so many
    rows come before the first. Others begin on whole times, a target width apart;
    keys with too little have none. Rows are counted by time, counts carried from
    bucket to bucket, and each block's start is looked up in them, a
    round for each: at most 2 MOST_BLOCKS + 1.
    """
    need = min(LAST_TIMES, max(2, least))
    t, first, place = F.col("t"), F.col("before"), F.col("place")
    times = df.where(F.col(ts).isNotNull()).groupBy(F.col(key).alias("k"), F.col(ts).cast("long").alias("t")).agg(F.count("*").alias("n"))
    times = running(times, ["k"], F.floor(t / bucket), ["t"], {"before": ("sum", F.col("n")), "place": ("sum", F.lit(1))}, inclusive=False)
    times = saved(times, "validation-times")
    whole = times.groupBy("k").agg(F.sum("n").alias("total"), F.count("*").alias("times"), F.max("t").alias("newest"))
    fits = whole.where((F.col("total") >= max(6, 2 * least)) & (F.col("times") > need))
    width = F.greatest(F.lit(least), F.floor(F.col("total") / (F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(2), F.floor(F.col("total") / least))) + 1)))
    fits = fits.withColumn("width", width)

    def found(state: DataFrame, rule: Column, best: Column, name: str) -> DataFrame:
        """``state`` with the time that ``best`` picks among those that keep ``rule``."""
        picked = state.join(times.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k"))).where(rule).groupBy("_k").agg(best.alias(name))
        return saved(state.join(picked, F.col("k").eqNullSafe(F.col("_k")), "left").drop("_k"), "validation-starts")

    at = F.struct("place", "before", "t")
    state = found(fits, (first <= F.col("total") - least) & (place <= F.col("times") - need), F.max(at), "last")
    state = state.where((F.col("last.before") >= least) & (F.col("total") - F.col("last.before") >= least)).withColumn("starts", F.array().cast("array<struct<place: bigint, before: bigint, t: bigint>>"))
    for _ in range(2 * MOST_BLOCKS + 1):  # a width is more than half of its even share
        since = F.coalesce(F.try_element_at("starts", F.lit(-1))["before"], F.lit(0))
        state = found(state, (first >= since + F.col("width")) & (place >= 1) & (place < F.col("last.place")), F.min(at), "next")
        if state.where("next is not null").isEmpty():
            state = state.drop("next")
            break
        state = state.withColumn("starts", F.when(F.col("next").isNull(), F.col("starts")).otherwise(F.array_append("starts", F.col("next")))).drop("next")
    blocks = state.withColumn("starts", F.array_append("starts", F.col("last"))).select("k", "total", "times", F.posexplode("starts").alias("block", "start"), F.col("starts").alias("all"))
    after = F.try_element_at("all", F.col("block") + 2)
    blocks = blocks.select("k", "block", F.col("start.t").alias("first_ts"), (F.coalesce(after["before"], F.col("total")) - F.col("start.before")).alias("n"), (F.coalesce(after["place"], F.col("times")) - F.col("start.place")).cast("int").alias("n_times"), (F.coalesce(after["place"], F.col("times")) - 1).alias("end"))
    ends = times.select(F.col("k").alias("_k"), F.col("place").alias("_end"), F.col("t").alias("last_ts"))
    return blocks.join(ends, F.col("k").eqNullSafe(F.col("_k")) & (F.col("end") == F.col("_end"))).select(F.col("k").alias(key), "block", "first_ts", "last_ts", "n", "n_times")


def label_balance(df: DataFrame, key: str, won: str) -> DataFrame:
    """Rows, wins and losses of each key, and twice the rarer of the two: what a fit may count on."""
    x = df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col(won)).alias("wins"))
    losses = F.col("total") - F.col("wins")
    return x.select(key, "total", "wins", losses.alias("losses"), (2 * F.least("wins", losses)).alias("effective"), (F.col("wins") / F.col("total")).alias("win_rate"))


def weighted_moments(df: DataFrame, key: str, values: list[str], weight: str) -> DataFrame:
    """Weighted mean and deviation (1e-6 at least) of each column; negative weights count as zero."""
    w = F.greatest(F.lit(0.0), F.col(weight))
    total = F.greatest(F.lit(1e-12), F.sum(w))
    mean = lambda c: F.sum(w * F.col(c)) / total
    spread = lambda c: F.greatest(F.lit(1e-6), F.sqrt(F.greatest(F.lit(0.0), F.sum(w * F.col(c) * F.col(c)) / total - mean(c) * mean(c) * (2 - F.sum(w) / total))))
    return df.groupBy(key).agg(*[mean(c).alias(f"{c}_mean") for c in values], *[spread(c).alias(f"{c}_std") for c in values])

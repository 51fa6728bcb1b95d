"""Direction and regime from votes of several time frames, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import clamp

# Weight of each time frame, by its seconds.
FRAME_WEIGHTS = {900: 1.0, 1800: 1.25, 3600: 2.0, 14400: 2.25, 86400: 0.75}
TACTICAL, STRUCTURAL = (900, 1800, 3600), (14400, 86400)


def vote(slope: Column, atr: Column, macd_hist: Column, rsi: Column, percent_b: Column) -> dict[str, Column]:
    """A time frame's vote in -1 to 1 and its trend strength, from indicators of log prices."""
    s = clamp(slope / F.greatest(F.lit(1e-6), atr) * 0.22, -1.0, 1.0)
    m = clamp(macd_hist / F.greatest(F.lit(1e-9), atr) * 4.0, -1.0, 1.0)
    x, b = clamp((rsi - 50) / 30, -1.0, 1.0), clamp((percent_b - 0.5) * 2, -1.0, 1.0)
    strength = clamp(F.abs(s) * 0.75 + F.abs(m) * 0.25)
    veto = F.when(strength < 0.15, 0.8).when(strength < 0.25, 0.4).otherwise(0.0)
    return {"score": clamp(0.55 * s + 0.22 * m + 0.15 * x + 0.08 * b, -1.0, 1.0), "trend_strength": strength, "neutral_veto": veto}


def _sign(x: Column, threshold: float = 0.10) -> Column:
    return F.when(x > threshold, 1).when(x < -threshold, -1).otherwise(0)


def aggregate(votes: DataFrame, key: str) -> DataFrame:
    """Direction, regime and confidences of each key from its votes (frame, score, trend_strength), one a frame.

    One partial aggregate; means are rounded to nine digits, so that thresholds
    do not depend on the order of addition. Frames without a weight do not count.
    """
    frame, score = F.col("frame"), clamp(F.col("score"), -1.0, 1.0)
    w = F.element_at(F.create_map(*[F.lit(x) for pair in FRAME_WEIGHTS.items() for x in pair]), frame.cast("int"))
    mean = lambda x, part: F.round(F.coalesce(F.try_divide(F.sum(F.when(part, w * x)), F.sum(F.when(part, w))), F.lit(0.0)), 9)
    every = frame.isin(*FRAME_WEIGHTS)
    sums = (
        votes.where(every)
        .groupBy(key)
        .agg(
            mean(score, frame.isin(*TACTICAL)).alias("tactical"),
            mean(score, frame.isin(*STRUCTURAL)).alias("structural"),
            mean(score, every).alias("s"),
            mean(clamp(F.col("trend_strength")), every).alias("trendiness"),
            F.sum(F.when(_sign(score) == 1, w).otherwise(0.0)).alias("_up"),
            F.sum(F.when(_sign(score) == -1, w).otherwise(0.0)).alias("_down"),
            F.sum(w).alias("_w"),
        )
    )
    side, active = _sign(F.col("structural")), F.col("_up") + F.col("_down")
    agree = F.when(side == 1, F.col("_up")).otherwise(F.col("_down"))
    coherence = F.when((side == 0) | (active == 0), 0.5).otherwise(0.5 + (F.try_divide(agree, active) - 0.5) * active / F.col("_w"))
    x = sums.withColumn("coherence", F.round(coherence, 9))
    return _decided(x).drop("_up", "_down", "_w")


def _decided(x: DataFrame) -> DataFrame:
    s, structural, trend, coherence = F.col("s"), F.col("structural"), F.col("trendiness"), F.col("coherence")
    name = lambda side: F.when(side > 0, "long").when(side < 0, "short").otherwise("neutral")
    overall, base = _sign(s), _sign(structural)
    regime = F.when((trend >= 0.48) & (coherence >= 0.50), "trend").when(trend <= 0.25, "range").otherwise("transition")
    x = x.withColumn("regime", regime).withColumn("bias", name(overall))
    biased = (overall != 0) & (overall == base) & (F.abs(s) >= 0.15) & (F.abs(structural) >= 0.10) & (coherence >= 0.62)
    plain = F.when(F.abs(s) < 0.12, "neutral").when(F.col("regime") != "range", F.when(s > 0, "long").otherwise("short")).when(biased, F.col("bias")).otherwise("neutral")
    # strong longer frames overrule a direction that is not theirs
    veto = (base != 0) & (F.abs(structural) >= 0.18) & (plain != name(base))
    x = x.withColumn("direction", F.when(~veto, plain).when(coherence >= 0.55, name(base)).otherwise("neutral")).withColumn("veto", veto)
    confidence = 0.30 + 0.52 * F.abs(s) + 0.18 * coherence + F.when(F.col("regime") == "trend", 0.08).when(F.col("regime") == "range", -0.08).otherwise(0.0)
    inside = (
        F.when(F.col("regime") == "trend", 0.65 * clamp((trend - 0.48) / 0.30) + 0.35 * clamp((coherence - 0.50) / 0.35))
        .when(F.col("regime") == "range", clamp((0.25 - trend) / 0.25))
        .otherwise(1 - clamp(F.abs(trend - 0.365) / 0.115))
    )
    return x.withColumn("confidence", clamp(confidence, 0.0, 0.99)).withColumn("regime_confidence", 0.25 + 0.75 * inside)


def stable_range(range_: Column, trendiness: Column, coherence: Column, regime: Column, reversion: Column, reversion_valid: Column) -> Column:
    """How well a market suits a grid: mean reversion weighs most where there is evidence of it."""
    c = clamp(F.coalesce(coherence, F.lit(0.5)))
    shift = F.when(regime == "range", 0.06 * c).when(regime == "trend", -0.04 * F.greatest(F.lit(0.0), c - 0.5)).otherwise(0.0)
    calm = clamp(1 - clamp(trendiness) + shift)
    return F.when(reversion_valid, clamp(0.15 * clamp(range_) + 0.30 * calm + 0.55 * clamp(reversion))).otherwise(clamp(0.20 * clamp(range_) + 0.80 * calm))


def funding_adjustment(direction: Column, events: Column, expected_bps: Column) -> Column:
    """What funding to be paid before the horizon takes off a score; funding received adds nothing."""
    pays = direction.isin("long", "short") & (events > 0)
    return F.when(pays & (expected_bps >= 8.0), -0.08).when(pays & (expected_bps >= 4.0), -0.05).when(pays & (expected_bps >= 1.5), -0.02).otherwise(0.0)


def policy_confidence(raw: Column, calibrated: Column, samples: Column, adjustment: Column) -> Column:
    """Raw and calibrated confidence, mixed by the model's sample count; null for values out of range."""
    share = F.least(F.lit(1.0), samples / 300.0) * 0.40 + 0.10
    ok = raw.between(0, 1) & calibrated.between(0, 1) & (samples > 0) & (adjustment > 0) & (adjustment <= 1)
    return F.when(ok, clamp(((1 - share) * raw + share * calibrated) * adjustment))


def first_touch_value(p_target: Column, p_stop: Column, p_horizon: Column, target: Column, stop: Column, horizon_mean: Column, horizon_low: Column, margin: Column) -> dict[str, Column]:
    """Expected net return of a first-touch event, and its low bound: ``margin`` of probability moves from the target to the worse of the other two ends."""
    low = F.greatest(F.lit(0.0), p_target - margin)
    freed, late = p_target - low, horizon_low < stop
    value = p_target * target + p_stop * stop + p_horizon * horizon_mean
    bound = low * target + (p_stop + F.when(late, 0.0).otherwise(freed)) * stop + (p_horizon + F.when(late, freed).otherwise(0.0)) * horizon_low
    reasons = [
        ("payoff", (target <= 0) | (stop >= 0)),
        ("likelihood", low <= F.least(F.lit(1.0), p_stop + margin)),
        ("expectancy", (value <= 0) | (bound <= 0)),
    ]
    return {"expected": value, "lower_bound": bound, "reasons": F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in reasons]))}

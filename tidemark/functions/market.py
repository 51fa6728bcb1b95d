"""Market arithmetic as columns: quotes, liquidity, funding, positions, plans and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp


def spread_bps(bid: Column, ask: Column) -> Column:
    """Spread over mid in basis points; null for missing or crossed quotes."""
    return F.when((bid > 0) & (ask >= bid), (ask - bid) / ((ask + bid) / 2) * 1e4)


def liquidity_tier(turnover: Column) -> Column:
    """Tier by daily turnover: high from 20 million, medium from 2, low from half a million, else thin; null is unknown."""
    return F.when(turnover.isNull(), "unknown").when(turnover >= 2e7, "high").when(turnover >= 2e6, "medium").when(turnover >= 5e5, "low").otherwise("thin")


def funding_bias(rate: Column) -> Column:
    """bullish below -1 basis point, bearish above 3, else neutral."""
    return F.when(rate.isNull(), "unknown").when(rate < -0.0001, "bullish").when(rate > 0.0003, "bearish").otherwise("neutral")


def funding_annual_pct(rate: Column, interval_min: Column) -> Column:
    """Funding rate as percent a year."""
    return F.when(interval_min > 0, rate * (525600.0 / interval_min) * 100)


def linear_pnl(side: Column, qty: Column, entry: Column, close: Column) -> Column:
    """Profit of a linear position; sides other than long and short give 0."""
    return F.when(side == "long", qty * (close - entry)).when(side == "short", qty * (entry - close)).otherwise(0.0)


def liquidation_price(side: Column, entry: Column, leverage: Column, maintenance: float = 0.005, fee: float = 0.001) -> Column:
    """Estimated liquidation price of a linear position; null for leverage or price of zero or less."""
    lost = 1.0 / leverage - maintenance - fee
    ok = (entry > 0) & (leverage > 0)
    return F.when(ok & (side == "long"), entry * (1.0 - lost)).when(ok & (side == "short"), entry * (1.0 + lost))


def plan_math(direction: Column, entry: Column, target: Column, stop: Column) -> dict[str, Column]:
    """Reward and risk in percent of entry and their ratio; null where target and stop are not on their sides of entry."""
    ok = (entry > 0) & F.when(direction == "long", (target > entry) & (stop < entry)).when(direction == "short", (target < entry) & (stop > entry)).otherwise(False)
    reward, risk = F.abs(target - entry) / entry * 100, F.abs(entry - stop) / entry * 100
    return {"reward_pct": F.when(ok, reward), "risk_pct": F.when(ok, risk), "rr": F.when(ok, F.try_divide(reward, risk))}


def trend_plan(atr: Column, cost: Column) -> dict[str, Column]:
    """Stop and reward distances of a trend entry, as shares of the price."""
    stop = F.greatest(F.lit(0.004), F.least(F.lit(0.08), F.greatest(1.25 * atr, 4 * cost, F.lit(0.004))))
    reward = F.greatest(F.lit(0.008), F.least(F.lit(0.15), F.greatest(1.8 * stop, 6 * cost, F.lit(0.008))))
    return {"stop": stop, "reward": reward}


def grid_score(range_: Column, coherence: Column, regime: Column, trend: Column, atr: Column, cost_bps: Column) -> Column:
    """Score of a grid entry in 0 to 1, without sentiment."""
    raw = 1.45 * range_ + 0.18 * coherence + 0.12 * regime - 0.45 * trend - 0.75 * clamp(atr / 0.06, 0.0, 2.0) - 0.40 * clamp(cost_bps / 20, 0.0, 2.5)
    return clamp(raw / 2.2)


def grid_levels(lower: Column, upper: Column, count: Column) -> Column:
    """The ``count`` + 1 prices of an arithmetic grid; null unless 0 < lower < upper and count > 0."""
    step = (upper - lower) / count
    return F.when((lower > 0) & (upper > lower) & (count > 0), F.transform(F.sequence(F.lit(0), count.cast("int")), lambda k: lower + k * step))


def blocks(*rules: tuple[str, Column]) -> Column:
    """Codes of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))

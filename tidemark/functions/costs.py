"""Costs of a trade, its exits and orders, quotes that can be trusted, and the utility of a candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .market import blocks
from .numeric import clamp, finite, strict_integer

#: Fixed value: seconds between fundings where an instrument does not say.
FUNDING_INTERVAL = 8 * 3600


def cost_model(grid: Column, linear: Column, direction: Column, spread_bps: Column, taker_bps: Column, rate: Column, next_funding: Column, interval_min: Column, now: Column, horizon: Column) -> dict[str, Column]:
    """What a trade costs in basis points: two fees, spread and slippage, and funding by the events until the horizon.

    Without a spread 10 counts (8 off linear venues). Longs pay positive rates,
    shorts negative ones, neutral grids the adverse side. The next event rolls
    forward to after ``now``; unknown, events are as many as intervals the horizon
    begins. Only funding to be paid counts for approval.
    """
    zero = F.lit(0.0)
    spread = F.when(finite(spread_bps).isNotNull(), F.greatest(zero, spread_bps)).otherwise(F.when(linear, 10.0).otherwise(8.0))
    fees = F.greatest(zero, F.coalesce(finite(taker_bps), zero)) * 2
    slippage = F.greatest(F.when(linear, 1.0).otherwise(0.8), spread * F.when(grid, 0.35).otherwise(0.50))
    each = F.when(direction == "long", rate * 1e4).when(direction == "short", -rate * 1e4).when((direction == "neutral") & grid & linear, F.abs(rate) * 1e4).otherwise(zero)
    known = strict_integer(interval_min.cast("double"))
    gap = F.when(known > 0, F.greatest(F.lit(60), known * 60)).otherwise(FUNDING_INTERVAL)
    stamp = F.when(next_funding > 100_000_000_000, F.floor(next_funding / 1000)).otherwise(next_funding)
    rolled = F.when(stamp > now, stamp).otherwise(stamp + (F.floor((now - stamp) / gap) + 1) * gap)
    scheduled = F.when(now + horizon >= rolled, 1 + F.floor((now + horizon - rolled) / gap)).otherwise(0)
    events = F.when((now > 0) & (stamp > 0), scheduled).otherwise(F.greatest(F.lit(1), F.ceil(horizon / gap)))
    events = F.when(F.coalesce(linear, F.lit(False)) & rate.isNotNull() & (horizon > 0), events).otherwise(0).cast("long")
    funding = F.coalesce(each * events, zero)
    execution = fees + spread + slippage
    return {"spread_bps": spread, "fee_bps": fees, "slippage_bps": slippage, "execution_bps": execution, "funding_events": events, "funding_bps": funding, "net_bps": execution + F.greatest(zero, funding), "signed_bps": execution + funding}


def resolved_integer(*candidates: Column) -> Column:
    """Several names of one integer as a struct: ok, value (where all agree), least, most, invalid (how many are no integers). Nulls are absent."""
    every = F.array(*[c.cast("double") for c in candidates])
    given = F.filter(every, lambda x: x.isNotNull())
    whole = F.filter(given, lambda x: strict_integer(x).isNotNull())
    values = F.array_distinct(F.transform(whole, lambda x: x.cast("long")))
    invalid = F.size(given) - F.size(whole)
    return F.struct(((invalid == 0) & (F.size(values) <= 1)).alias("ok"), F.when(F.size(values) == 1, F.try_element_at(values, F.lit(1))).alias("value"), F.array_min(values).alias("least"), F.array_max(values).alias("most"), invalid.alias("invalid"))


def exits(direction: Column, lower: Column, upper: Column) -> Column:
    """Take-profit and stop of a side between its kill switches; neutral grids have neither."""
    long, short = direction == "long", direction == "short"
    return F.struct(F.when(long, upper).when(short, lower).alias("take_profit"), F.when(long, lower).when(short, upper).alias("stop_loss"))


def order_side(direction: Column, action: Column) -> Column:
    """Side of an order and whether it may only reduce, for a long or short that opens or closes; null otherwise."""
    ok = direction.isin("long", "short") & action.isin("open", "close")
    buys = (direction == "long") == (action == "open")
    return F.when(ok, F.struct(F.when(buys, "Buy").otherwise("Sell").alias("side"), (action == "close").alias("reduce_only")))


def distance_to_bound(price: Column, bound: Column, side: Column) -> Column:
    """Room to a bound in percent of the price, negative once it is passed."""
    away = F.when(side == "lower", price - bound).when(side == "upper", bound - price)
    return F.when(price > 0, away / price * 100)


def valid_quote(last: Column, bid: Column, ask: Column, turnover: Column, volume: Column) -> Column:
    """Whether a ticker can be trusted: what it has must be finite, prices positive and not crossed, amounts not negative."""
    good = lambda c, rule: c.isNull() | (finite(c).isNotNull() & rule)
    rules = [good(c, c > 0) for c in (last, bid, ask)] + [good(c, c >= 0) for c in (turnover, volume)] + [bid.isNull() | ask.isNull() | (ask >= bid)]
    out = F.lit(True)
    for rule in rules:
        out = out & rule
    return F.coalesce(out, F.lit(False))


def day_start(ts: Column, zone: str = "UTC") -> Column:
    """Seconds of the midnight before a time, in a zone."""
    local = F.from_utc_timestamp(F.timestamp_seconds(ts), zone)
    return F.unix_timestamp(F.to_utc_timestamp(F.date_trunc("day", local), zone))


def utility(lower: list[Column], means: list[Column], shortfall: Column, confidence: Column, threshold: Column) -> dict[str, Column]:
    """Risk-adjusted utility of a candidate: its least lower bound and a fifth of the way to its least mean, by how far confidence passes the threshold, less a twentieth of the tail's loss; and codes of what keeps it from counting."""
    floor_, mean = F.least(*lower), F.least(*means)
    margin = clamp((confidence - threshold) / F.greatest(F.lit(1e-12), 1 - threshold))
    value = floor_ + 0.20 * margin * F.greatest(F.lit(0.0), mean - floor_) - 0.05 * F.greatest(F.lit(0.0), -shortfall)
    missing = lambda cs: F.greatest(*[c.isNull() for c in cs])
    fits = F.coalesce((threshold >= 0) & (threshold < 1) & (confidence >= threshold) & (confidence <= 1), F.lit(False))
    codes = blocks(
        ("CANDIDATE_CONFIDENCE_BELOW_VALIDATED_POLICY", ~fits), ("POLICY_MEAN_RETURN_UNAVAILABLE", missing(means)), ("POLICY_LOWER_BOUND_UNAVAILABLE", missing(lower)), ("POLICY_LOWER_BOUND_NON_POSITIVE", ~missing(lower) & (floor_ <= 0)), ("EXPECTED_SHORTFALL_UNAVAILABLE", shortfall.isNull())
    )
    fine = F.size(codes) == 0
    return {"utility": F.when(fine, value), "codes": F.when(fine & (value <= 0.00005), F.array(F.lit("RISK_ADJUSTED_UTILITY_NON_POSITIVE"))).otherwise(codes)}

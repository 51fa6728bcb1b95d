"""Rules of a decision as columns: gates with their codes, confidence, status, horizons and the economics of an order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .direction import policy_confidence
from .market import blocks
from .numeric import clamp

#: Shortest and longest label horizon of each strategy, in hours, and the default of the two.
HORIZON_HOURS = {"futures_grid": (6, 48, 12), "directional_trend": (3, 24, 12)}
#: Fixed value: seconds after a horizon's end before a label may be used.
LABEL_GRACE = 120


def holds(rule: Column) -> Column:
    """A condition that counts as false where it is null."""
    return F.coalesce(rule, F.lit(False))


def oi_trend(change_24h_pct: Column) -> Column:
    """growing above 3 percent in a day, falling below -3, stable between; unknown without a value."""
    return F.when(change_24h_pct.isNull(), "unknown").when(change_24h_pct > 3, "growing").when(change_24h_pct < -3, "falling").otherwise("stable")


def oi_signal(trend: Column, direction: Column) -> Column:
    """Open interest read with the price's direction: growth backs the side that moves, a fall is caution."""
    growing = trend == "growing"
    return F.when(growing & (direction == "long"), "bullish").when(growing & (direction == "short"), "bearish").when(trend == "falling", "caution").otherwise("neutral")


def blended_sentiment(market: Column, symbol: Column, points: Column) -> Column:
    """The market's sentiment with a symbol's own, which weighs a twentieth a point, from a tenth to a half; the market's alone where the symbol has none."""
    w = clamp(points / 20, 0.1, 0.5)
    return F.when(symbol.isNull(), market).otherwise((1 - w) * market + w * symbol)


def mean_reversion_gate(valid: Column, frames: Column, score: Column, floor: Column) -> Column:
    """blocked without valid evidence of three frames, no_trade below the floor, else pass."""
    return F.when(~(holds(valid) & holds(frames >= 3)), "blocked").when(clamp(score) < clamp(floor), "no_trade").otherwise("pass")


def funding_extreme(direction: Column, rate: Column, events: Column, expected_bps: Column) -> Column:
    """Whether a side is to pay 6 basis points of funding or more."""
    return holds(direction.isin("long", "short") & rate.isNotNull() & (events > 0) & (F.coalesce(expected_bps, F.lit(0.0)) >= 6))


def shock_gate(state: Column, direction: Column, blocks_neutral: Column) -> Column:
    """The code that a market state puts on an entry; null for none."""
    down, up, neutral = state == "amber_down", state == "amber_up", (direction == "neutral") & holds(blocks_neutral)
    return (
        F.when(state.isin("red_down", "red_up", "chaos"), "MARKET_LOCKDOWN")
        .when(down & (direction == "long"), "MARKET_GUARDED_DOWN")
        .when(up & (direction == "short"), "MARKET_GUARDED_UP")
        .when(down & neutral, "MARKET_GUARDED_DOWN_NEUTRAL")
        .when(up & neutral, "MARKET_GUARDED_UP_NEUTRAL")
    )


def fast_veto(direction: Column, r1: Column, r3: Column, r5: Column, volume_z: Column) -> Column:
    """State of a symbol's last minutes against an entry: down_break, up_break, volatility_spike or normal. Returns are shares."""
    z = F.coalesce(volume_z, F.lit(0.0))
    down = (r1 <= -0.006) & (r3 <= -0.010) & (r5 <= -0.018) & (z >= 0.75)
    up = (r1 >= 0.006) & (r3 >= 0.010) & (r5 >= 0.018) & (z >= 0.75)
    return F.when((direction == "long") & down, "down_break").when((direction == "short") & up, "up_break").when((direction == "neutral") & (F.abs(r5) >= 0.020) & (z >= 0.90), "volatility_spike").otherwise("normal")


def trigger_errors(direction: Column, exit_kind: Column, reference: Column, trigger: Column) -> Column:
    """Codes of what is wrong with a protective order: of a bad side or price just that, else of its place and of the way it must be reached."""
    rise = ((direction == "long") & (exit_kind == "take_profit")) | ((direction == "short") & (exit_kind == "stop_loss"))
    wrong = F.when(rise, trigger <= reference).otherwise(trigger >= reference)
    place = F.concat(F.upper(direction), F.when(exit_kind == "take_profit", "_TP").otherwise("_SL"), F.lit("_TRIGGER_NOT_"), F.when(rise, "ABOVE").otherwise("BELOW"), F.lit("_REFERENCE"))
    mismatch = F.when(rise, ~(trigger > reference)).otherwise(trigger > reference)
    one = lambda code: F.array(F.lit(code))
    return (
        F.when(~holds(direction.isin("long", "short")), one("PROTECTIVE_DIRECTION_INVALID"))
        .when(~holds(reference > 0), one("PROTECTIVE_REFERENCE_PRICE_INVALID"))
        .when(~holds(trigger > 0), one("PROTECTIVE_TRIGGER_PRICE_INVALID"))
        .otherwise(F.array_compact(F.array(F.when(wrong, place), F.when(mismatch, F.lit("PROTECTIVE_TRIGGER_DIRECTION_MISMATCH")))))
    )


def status(codes: Column, score: Column, least_score: float, confidence: Column, least_confidence: float, gated: Column) -> Column:
    """blocked by any code, no_trade for too low a score or, where confidence gates, too little of it; else recommended."""
    return F.when(F.size(codes) > 0, "blocked").when(score < least_score, "no_trade").when(holds(gated) & (confidence < least_confidence), "no_trade").otherwise("recommended")


def context_multiplier(atr: Column, sentiment: Column, open_interest: Column, funding: Column, frames: Column, linear: Column) -> Column:
    """What is left of confidence for the inputs that are missing: flags say that one is there."""
    part = lambda there, factor: F.when(holds(there), 1.0).otherwise(factor)
    return part(atr, 0.92) * part(sentiment, 0.94) * part(open_interest | ~linear, 0.96) * part(funding | ~linear, 0.98) * part(frames >= 3, 0.93)


def confidence(raw: Column, calibrated: Column, samples: Column, multiplier: Column, unwinding: Column, guarded: Column) -> Column:
    """Confidence of a raw score: its sigmoid at 2.1 times, 0.7 at most, after context, an unwinding and a guarded market, one clamp at a time.

    Where a calibrated value is there, the policy's mix of both by its samples
    takes the product of these factors instead; out of range, it is 0.
    """
    own, unwound, wary = 1 / (1 + F.exp(-2.1 * raw)), F.when(holds(unwinding), 0.88).otherwise(1.0), F.when(holds(guarded), 0.93).otherwise(1.0)
    plain = clamp(clamp(clamp(F.least(own, F.lit(0.70)) * multiplier) * unwound) * wary)
    mixed = policy_confidence(own, calibrated, samples, multiplier * unwound * wary)
    return F.when(calibrated.isNull(), plain).otherwise(F.coalesce(mixed, F.lit(0.0)))


def guarded_score(score: Column, guarded: Column, blocked: Column) -> Column:
    """A score in a guarded market counts 0.92 of itself, unless it is blocked anyway."""
    return F.when(holds(guarded) & ~holds(blocked), clamp(score * 0.92, -1.0, 1.0)).otherwise(score)


def risk_score(atr_pct: Column) -> Column:
    """Average range against a tenth of the price, 0 to 1."""
    return clamp(atr_pct / 0.10)


def model_matches(version: Column, current: str) -> Column:
    """Whether a version is the current one, or it and something after a plus sign."""
    v, want = F.trim(F.coalesce(version, F.lit(""))), current.strip()
    return (v == want) | v.startswith(want + "+") if want else F.lit(False)


def confidence_passes(status_: Column, confidence_: Column, least: float, gated: Column) -> Column:
    """Actionable rows need ``least`` confidence where it gates; others pass."""
    return ~holds(status_.isin("recommended", "active", "pending")) | ~holds(gated) | (F.coalesce(confidence_, F.lit(0.0)) >= least)


def safe_shadow(status_: Column, eligible: Column, role: Column, passed: Column, n_blocks: Column) -> Column:
    """A no_trade row that its publisher opened to evaluation and risk checks found clean."""
    return holds((F.lower(F.trim(status_)) == "no_trade") & eligible & (F.trim(role) == "shadow_no_trade") & passed & (n_blocks == 0))


def label_eligible(status_: Column, shadow: Column, review: Column, ready: tuple[str, ...] = ("completed", "done", "ok")) -> Column:
    """Whether an outcome of a row counts: safe shadows do, pending, blocked and suppressed rows do not, others once their review is one of ``ready``."""
    s = F.lower(F.trim(F.coalesce(status_, F.lit(""))))
    return F.when(s == "no_trade", holds(shadow)).when(s.isin("pending", "blocked", "suppressed"), False).otherwise(holds(F.lower(F.trim(review)).isin(*ready)))


def plausible_time(ts: Column, now: Column, skew: int = 300) -> Column:
    """Whether a time is positive and no more than ``skew`` seconds ahead."""
    return holds((ts > 0) & (ts <= now + skew))


def seconds(ts: Column) -> Column:
    """A remote time in seconds; milliseconds are told by their size."""
    return F.when(ts > 100_000_000_000, F.floor(ts / 1000)).otherwise(ts).cast("long")


def horizon(strategy: Column, hours: Column, fallback: int) -> Column:
    """Seconds until a label: the hours a plan asks for, within the strategy's bounds, or its default."""
    out = F.when(hours > 0, F.greatest(F.lit(0.5), F.least(F.lit(72.0), hours)) * 3600).otherwise(fallback)
    for name, (low, high, default) in HORIZON_HOURS.items():
        own = F.when(hours > 0, F.greatest(F.lit(low), F.least(F.lit(high), hours)) * 3600).otherwise(default * 3600)
        out = F.when(strategy == name, own).otherwise(out)
    return out.cast("long")


def label_due(ts: Column, horizon_: Column, grace: int = LABEL_GRACE) -> Column:
    """When a label may be used; null unless all are positive."""
    return F.when((ts > 0) & (horizon_ > 0), ts + horizon_ + grace)


def round_trip_fee(entry_notional: Column, exit_notional: Column, fee_bps: Column) -> Column:
    """Fee of both legs; negative inputs count as zero."""
    zero = F.lit(0.0)
    return (F.greatest(zero, entry_notional) + F.greatest(zero, exit_notional)) * F.greatest(zero, fee_bps) / 1e4


def funding_cashflow(side: Column, notional: Column, rate: Column, events: Column) -> Column:
    """What funding costs a position (negative: earns); sides other than long and short pay nothing."""
    sign = F.when(side == "long", 1.0).when(side == "short", -1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), notional) * rate * F.greatest(F.lit(0), events) * sign


def margin_required(notional: Column, leverage: Column) -> Column:
    """Notional over leverage; leverage of zero or less counts as one."""
    return F.greatest(F.lit(0.0), notional) / F.when(leverage > 0, leverage).otherwise(1.0)


def liquidation_buffer(side: Column, reference: Column, liquidation: Column) -> Column:
    """Way from the price to liquidation in percent, 0 at least; null for other sides or prices of zero or less."""
    away = F.when(side == "short", liquidation - reference).when(side == "long", reference - liquidation)
    return F.when((reference > 0) & (liquidation > 0) & away.isNotNull(), F.greatest(F.lit(0.0), away / reference * 100))


def grid_leg(step_pct: Column, notional: Column, taker_bps: Column, cost_bps: Column, funding_bps: Column, fill: Column) -> dict[str, Column]:
    """Economics of one grid step, in basis points and money: gross, costs (two fees at least), net, net after adverse funding and with what fills are likely."""
    zero = F.lit(0.0)
    gross = F.greatest(zero, step_pct / 100) * 1e4
    cost = F.greatest(F.greatest(zero, cost_bps), F.greatest(zero, taker_bps) * 2)
    net, size = gross - cost, F.greatest(zero, notional)
    return {
        "gross_bps": gross, "cost_bps": cost, "net_bps": net, "stress_bps": net - F.greatest(zero, funding_bps), "signed_bps": net - funding_bps,
        "projected_bps": gross * F.least(F.lit(1.0), F.greatest(zero, fill)) - cost, "net_money": size * gross / 1e4 - size * cost / 1e4, "breakeven": (net > 0) & (size > 0),
    }


#: Codes of blocks after a plan is made, in their order.
ECONOMICS_CODES = ("GRID_ECONOMICS_MISSING", "GRID_NET_PROFIT_NON_POSITIVE", "GRID_NET_PROFIT_TOO_THIN", "GRID_GROSS_EDGE_BELOW_COSTS", "LIQUIDATION_BUFFER_TOO_LOW", "MIN_LEVERAGE_PER_BOT", "MAX_LEVERAGE_PER_BOT", "MAX_POSITION_NOTIONAL_PER_BOT", "MAX_MARGIN_PER_BOT")


def economics_blocks(net_bps: Column, gross_bps: Column, cost_bps: Column, buffer_pct: Column, leverage: Column, leverages: tuple[float, float], notional: Column, most_notional: float, margin: Column, most_margin: float) -> Column:
    """Codes of a finished grid plan: a step's profit missing, none or thin, gross profit near its costs, a small buffer, and what breaks a bound."""
    rules = [net_bps.isNull(), net_bps <= 0, (net_bps > 0) & (net_bps < 2), (cost_bps > 0) & (gross_bps <= cost_bps * 1.10), buffer_pct < 12, leverage < leverages[0], leverage > leverages[1], notional > most_notional, margin > most_margin]
    return blocks(*zip(ECONOMICS_CODES, rules, strict=True))

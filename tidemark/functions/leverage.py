"""Leverage of a grid within the operator's interval, and the roles of its outcome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp
from .policy import holds

#: Quality, net basis points and range of a promotion just above the least leverage, and how they change up to the most.
QUALITY, NET, RANGE = (0.58, 0.22), (3.0, 4.0), (0.023, -0.006)
#: Range and cost that are unsafe, range too high, and net basis points too few.
UNSAFE_RANGE, UNSAFE_COST, HIGH_RANGE, LEAST_NET = 0.05, 45.0, 0.025, 2.0


def promoted(least: Column, most: Column, setup: Column, net_bps: Column, atr: Column, cost_bps: Column) -> tuple[Column, Column]:
    """(leverage, quality): the greatest of the interval whose own bounds on quality, net edge and range are met, or the least."""
    low = F.greatest(F.lit(1), F.coalesce(least, F.lit(1)))
    high = F.greatest(low, F.coalesce(most, low))
    quality = clamp(0.45 * clamp(setup) + 0.35 * clamp((net_bps - 2.0) / 8.0) + 0.15 * clamp((0.025 - atr) / 0.020) + 0.05 * clamp((45.0 - cost_bps) / 30.0))

    def fits(level: Column) -> Column:
        share = (level - low) / F.greatest(F.lit(1), high - low)
        return (quality >= QUALITY[0] + QUALITY[1] * share) & (net_bps >= NET[0] + NET[1] * share) & (atr <= RANGE[0] + RANGE[1] * share)

    better = F.filter(F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<int>")), fits)
    return F.coalesce(F.array_max(better), low), quality


def operator_leverage(direction: Column, strength: Column, range_score: Column, trendiness: Column, atr: Column, cost_bps: Column, funding_bps: Column, gross_bps: Column, least: Column, most: Column, safe_most: Column) -> dict[str, Column]:
    """leverage, approved, note and setup quality. ``safe_most`` (null: unknown) caps promotions, not the least; hard limits on range, cost and net edge decline."""
    side = F.lower(F.trim(F.coalesce(direction, F.lit("neutral"))))
    low = F.greatest(F.lit(1), F.coalesce(least, F.lit(1)))
    high = F.greatest(low, F.coalesce(most, low))
    top = F.when(safe_most.isNull(), high).otherwise(F.greatest(low, F.least(high, F.greatest(F.lit(1), safe_most))))
    positive = lambda x: F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0)))
    range_, cost = positive(atr), positive(cost_bps)
    net = positive(gross_bps) - cost - positive(funding_bps)
    sided = F.when(side.isin("long", "short"), clamp(strength)).otherwise(0.0)
    flat = F.when(side == "neutral", clamp(range_score) * (1 - F.least(F.lit(0.75), clamp(trendiness) * 0.75))).otherwise(0.0)
    setup = clamp(F.greatest(sided, flat))
    chosen, _ = promoted(low, top, setup, net, range_, cost)
    note = (
        F.when((low <= 1) & (high <= 1), "operator_minimum_is_one").when((range_ >= UNSAFE_RANGE) | (cost >= UNSAFE_COST), "unsafe_volatility_or_execution_cost").when(range_ > HIGH_RANGE, "atr_too_high_for_operator_minimum")
        .when(net < LEAST_NET, "insufficient_net_edge_for_operator_minimum").when((low == high) | (chosen == low), "operator_minimum_selected").otherwise("adaptive_interval_selected")
    )
    return {"leverage": chosen, "approved": note.startswith("operator_minimum") | (note == "adaptive_interval_selected"), "note": note, "setup": setup}


#: Statuses of rows that are acted on.
ACTIONABLE = ("recommended", "active", "executed")


def outcome_roles(status: Column, n_blocks: Column, reasons: Column, evidence_codes: list[str], plan_complete: Column, price_valid: Column, score: Column, floor: Column | float, rejected: Column) -> dict[str, Column]:
    """eligible, policy_evaluation_eligible, calibration_role, sample_role and reason of a row's outcome.

    ``reasons`` are the codes for which it is no trade; those in
    ``evidence_codes`` do not keep it from evaluation. ``rejected``: its trend
    direction was not confirmed.
    """
    complete = holds(plan_complete) & ~holds(rejected)
    sound = complete & F.coalesce(price_valid, F.lit(True)) & (n_blocks == 0)
    acted, shadow = holds(status.isin(*ACTIONABLE)), holds(status == "no_trade") & sound
    others = F.size(F.filter(reasons, lambda c: ~c.isin(*evidence_codes))) > 0
    evaluated = holds(score >= floor) & sound & ~others
    return {
        "eligible": acted | shadow, "policy_evaluation_eligible": evaluated, "calibration_role": F.when(evaluated, "current_policy_evaluation").when(shadow, "shadow_exploration").otherwise("excluded"),
        "sample_role": F.when(shadow, "shadow_no_trade").when(acted, "actionable_root").otherwise("excluded"),
        "reason": F.when(holds(rejected), "trend_direction_unconfirmed_evaluation_excluded").when(shadow, "model_thesis_or_launch_gate").when(acted, "actionable_publication").otherwise("hard_or_incomplete_candidate"),
    }

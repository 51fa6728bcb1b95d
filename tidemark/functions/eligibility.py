"""Whether a labelled outcome counts for the policy in force, and why not: cohorts, scopes, directions, reason codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import number
from .policy import LABEL_GRACE, holds, model_matches

#: Strategies that are supported, and the one judged by its trend.
STRATEGIES, TREND = ("futures_grid", "directional_trend"), "directional_trend"


def text(v: Column, path: str) -> Column:
    """Trimmed text at ``path``; empty counts as missing."""
    found = F.trim(F.try_variant_get(v, path, "string"))
    return F.when(found != "", found)


def flag(v: Column, path: str) -> Column:
    """Whether exactly true is at ``path``; text and numbers are not."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return holds((kind == "BOOLEAN") & F.try_variant_get(v, path, "boolean"))


def whole(v: Column, path: str) -> Column:
    """The whole number at ``path``, or null."""
    x = number(v, path)
    return F.when(x == F.floor(x), x.cast("long"))


def is_fingerprint(x: Column) -> Column:
    """Whether a text is a SHA-256 in lower-case hex."""
    return holds(x.rlike("^[0-9a-f]{64}$"))


def contract_fingerprint(v: Column) -> Column:
    """SHA-256 of the attached contract as JSON of sorted keys without spaces, numbers without trailing zeros; null if there is none or it is no object."""
    contract = F.try_variant_get(v, "$.outcome_policy.policy_contract", "variant")
    return F.when(F.schema_of_variant(contract).startswith("OBJECT"), F.sha2(F.to_json(contract), 256))


def directions(e: Column, stated: Column, outcome: Column) -> dict[str, Column]:
    """raw_direction (before execution), execution_direction, and the source of a neutral one; ``e`` is a column of :func:`evidence`."""
    known = lambda x, fallback: F.when(F.lower(F.trim(x)).isin("long", "short", "neutral"), F.lower(F.trim(x))).otherwise(fallback)
    present = lambda x: F.when(x != "", x)
    last = known(present(outcome), F.lit("neutral"))
    raw = known(F.coalesce(e["raw"], present(stated), present(outcome), last), last)
    done = known(F.coalesce(e["done"], present(stated), present(outcome), last), last)
    source = F.when(done != "neutral", None).when(raw == "short", "futures_neutral").when(raw == "neutral", "true_neutral").otherwise("other_neutralized")
    return {"raw_direction": raw, "execution_direction": done, "neutral_source": source}


def decision_codes(v: Column) -> Column:
    """Codes of the decision's no-trade reasons, then of risk blocks, each once; entries are objects with a code or reason, or plain text."""
    lists = [F.coalesce(F.try_variant_get(v, p, "array<variant>"), F.array().cast("array<variant>")) for p in ("$.decision_layers.no_trade_reasons", "$.risk_checks.blocks")]
    code = lambda e: F.coalesce(text(e, "$.code"), text(e, "$.reason"), F.when(~F.schema_of_variant(e).startswith("OBJECT"), F.nullif(F.trim(F.try_variant_get(e, "$", "string")), F.lit(""))))
    return F.array_distinct(F.filter(F.transform(F.concat(*lists), code), lambda c: c.isNotNull()))


def evidence(v: Column) -> Column:
    """What the rules here read of a row's reasons (a variant; null: none), as one struct.

    To be made a column of its own before the rules: they use each part many
    times, and would look it up in the variant, or hash its contract, each time.
    """
    snap, policy = "$.feature_snapshot.", "$.outcome_policy."
    chosen = lambda *paths: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{p}", "string"), F.lit("")) for p in paths])
    own = F.lower(text(v, policy + "policy_fingerprint"))
    parts = {
        "reversion": number(v, snap + "mean_reversion_score"), "strength": number(v, snap + "trend_strength"), "coherence": number(v, snap + "coherence"),
        "reversion_valid": holds(whole(v, snap + "mean_reversion_evidence_valid") == 1), "trend_valid": flag(v, snap + "trend_evidence_valid") | holds(whole(v, snap + "trend_evidence_valid") == 1),
        "regime": F.lower(F.coalesce(text(v, snap + "regime"), F.lit(""))),
        "floor": number(v, policy + "policy_contract.selection.min_score_to_recommend"), "least": number(v, policy + "policy_contract.selection.mean_reversion_min_score"),
        "grace": F.coalesce(whole(v, policy + "policy_contract.calibration.label_due_grace_sec"), F.lit(LABEL_GRACE).cast("long")),
        "evaluated": flag(v, policy + "policy_evaluation_eligible"), "counted": flag(v, policy + "eligible"), "own": own, "contract": contract_fingerprint(v),
        "said": whole(v, policy + "label_due_ts"), "shadow": holds(text(v, policy + "sample_role") == "shadow_no_trade"), "codes": decision_codes(v),
        "raw": chosen("execution_constraints.raw_direction", "direction_agg.raw_direction", "direction_agg.direction_before_execution"),
        "done": chosen("execution_constraints.executable_direction", "execution_constraints.execution_direction"),
    }
    return F.struct(*[c.alias(name) for name, c in parts.items()])


def eligibility(e: Column, bot: Column, score: Column, ts: Column, horizon: Column, available: Column, stored: dict[str, Column], active: Column, now: Column) -> dict[str, Column]:
    """cohort, calibration_eligible, policy_evaluation_eligible, outcome_eligible and reason_codes of a labelled outcome.

    ``e`` is a column of :func:`evidence`, ``active`` the fingerprint of the
    policy in force (null: unspecified), ``stored`` may hold the columns policy
    and outcome with materialised flags (0, 1 or null). The contract counts only
    if its own hash is the stored fingerprint. Codes name every gate that is not
    passed, in a fixed order.
    """
    trending = F.trim(F.coalesce(bot, F.lit(""))) == TREND
    reversion, strength, coherence, regime, floor, least = (e[c] for c in ("reversion", "strength", "coherence", "regime", "floor", "least"))
    evaluated, counted, own, said = e["evaluated"], e["counted"], e["own"], e["said"]
    unit = lambda x: holds(x.between(0.0, 1.0))
    reverts = e["reversion_valid"] & unit(reversion)
    trends = e["trend_valid"] & unit(strength) & unit(coherence) & (regime == "trend")
    verified = is_fingerprint(own) & holds(e["contract"] == own)
    named = is_fingerprint(F.lower(F.trim(active)))
    match = named & holds(own == F.lower(F.trim(active)))
    due = F.when((ts > 0) & (horizon > 0) & (e["grace"] >= 0), ts + horizon + e["grace"])
    kept = holds(said == due) & holds(available >= due)
    ripe = holds(F.greatest(said, available) <= now) & said.isNotNull() & available.isNotNull()
    scored = holds(score >= floor)
    backed = F.when(trending, trends).otherwise(reverts & holds(reversion >= least))
    calibrates = match & verified & evaluated & scored & backed & kept & ripe
    codes = [
        ("ACTIVE_POLICY_UNSPECIFIED", ~named), ("ACTIVE_POLICY_FINGERPRINT_MISMATCH", named & ~match), ("POLICY_CONTRACT_UNVERIFIED", ~verified), ("POLICY_EVALUATION_EXCLUDED", ~evaluated),
        ("SCORE_INVALID", score.isNull()), ("SCORE_POLICY_FLOOR_MISSING", floor.isNull()), ("SCORE_BELOW_POLICY_FLOOR", score < floor),
        ("TREND_EVIDENCE_INVALID", trending & ~trends), ("TREND_STRENGTH_INVALID", trending & ~unit(strength)), ("TREND_COHERENCE_INVALID", trending & ~unit(coherence)), ("TREND_REGIME_MISMATCH", trending & (regime != "trend")),
        ("MEAN_REVERSION_EVIDENCE_INVALID", ~trending & ~reverts), ("MEAN_REVERSION_POLICY_FLOOR_MISSING", ~trending & least.isNull()), ("MEAN_REVERSION_BELOW_POLICY_FLOOR", ~trending & reverts & (reversion < least)),
        ("LABEL_DUE_MISSING", said.isNull()), ("LABEL_DUE_CONTRACT_MISMATCH", said != due), ("LABEL_AVAILABILITY_MISSING", available.isNull()), ("LABEL_AVAILABILITY_PREMATURE", available < due), ("LABEL_NOT_MATURED", ~ripe),
        *[(f"MATERIALIZED_{name.upper()}_ELIGIBILITY_MISMATCH", stored[name].isin(0, 1) & ((stored[name] == 1) != flag_)) for name, flag_ in (("policy", evaluated), ("outcome", counted)) if name in stored],
    ]
    own_codes = F.filter(F.array(*[F.when(holds(rule), F.lit(code)) for code, rule in codes]), lambda c: c.isNotNull())
    cohort = (
        F.when(named & ~match, "other_policy").when(calibrates, "calibration_eligible").when(evaluated & verified, "policy_evaluation_candidate")
        .when(counted & e["shadow"], "shadow_exploration").when(counted, "outcome_only").otherwise("excluded")
    )
    return {"cohort": cohort, "calibration_eligible": calibrates, "policy_evaluation_eligible": evaluated, "outcome_eligible": counted, "reason_codes": F.array_distinct(F.concat(own_codes, e["codes"]))}


def in_scope(v: Column, version: Column, scope: str, current_version: str, fingerprint: str | None = None) -> Column:
    """Whether a row belongs to ``scope``: archive (all), current_model, or current_policy (its contract hashes to ``fingerprint`` too)."""
    if scope == "archive":
        return F.lit(True)
    fits = model_matches(version, current_version)
    if scope == "current_model":
        return fits
    if fingerprint is None or len(fingerprint) != 64:
        raise ValueError("the current policy needs its fingerprint")
    own = F.lower(text(v, "$.outcome_policy.policy_fingerprint"))
    return fits & holds(own == fingerprint) & holds(contract_fingerprint(v) == own)

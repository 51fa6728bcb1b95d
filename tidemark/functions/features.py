"""Feature vectors out of JSON reasons, read as variants: malformed rows get a code, not a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, finite

#: Name, default and bounds of each feature of a stored snapshot that stands alone, in the order of the vector (direction_sign and sentiment_alignment follow).
SNAPSHOT = [
    ("range_score", 0.5, 0.0, 1.0), ("trend_strength", 0.0, 0.0, 1.0), ("atr_pct_norm", 0.0, 0.0, 2.0), ("effective_sentiment", 0.0, -1.0, 1.0), ("dir_conf", 0.5, 0.0, 1.0),
    ("coherence", 0.5, 0.0, 1.0), ("spread_bps_norm", 0.8, 0.0, 5.0), ("score", None, -1.0, 1.0), ("oi_4h_norm", 0.0, -3.0, 3.0), ("funding_norm", 0.0, -2.0, 2.0),
    ("liq_tier_num", 0.67, 0.0, 1.0), ("btc_corr", 0.0, -1.0, 1.0), ("regime_conf", 0.5, 0.0, 1.0),
]
#: Numbers of liquidity tiers.
TIERS = {"micro": 0.0, "low": 0.33, "medium": 0.67, "high": 1.0}


def variant(json: Column) -> Column:
    """JSON text as a variant; null if it is malformed or no object."""
    v = F.try_parse_json(json)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def number(v: Column, path: str) -> Column:
    """A finite number, or text that is one, at ``path``; flags and anything else are null."""
    flag = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN"
    return F.when(~F.coalesce(flag, F.lit(False)), finite(F.try_variant_get(v, path, "string").try_cast("double")))


def there(v: Column, path: str) -> Column:
    """Whether something, null too, is at ``path``."""
    return F.try_variant_get(v, path, "variant").isNotNull()


def factor(v: Column, name: str) -> Column:
    """The value of the first factor of that name with one, among positive, then negative factors."""
    lists = [F.coalesce(F.try_variant_get(v, f"$.{x}", "array<variant>"), F.array().cast("array<variant>")) for x in ("top_positive_factors", "top_negative_factors")]
    named = F.filter(F.concat(*lists), lambda f: (F.try_variant_get(f, "$.feature", "string") == name) & F.try_variant_get(f, "$.value", "string").isNotNull())
    return F.when(F.size(named) > 0, F.coalesce(number(F.get(named, 0), "$.value"), F.lit(0.0)))


def direction_sign(direction: Column) -> Column:
    """1, -1 or 0 for long, short and the rest."""
    side = F.lower(F.trim(F.coalesce(direction, F.lit(""))))
    return F.when(side == "long", 1.0).when(side == "short", -1.0).otherwise(0.0)


def alignment(sign: Column, sentiment: Column) -> Column:
    """How far sentiment backs a side; for none, any sentiment is adverse."""
    return F.when(sign != 0, sign * sentiment).otherwise(-F.abs(sentiment))


def _or(value: Column, default: float | Column) -> Column:
    return F.coalesce(value, F.lit(default) if isinstance(default, float) else default)


def _from_snapshot(v: Column, score: Column, sign: Column) -> list[Column]:
    """The vector of a stored snapshot."""
    found = [clamp(_or(number(v, f"$.feature_snapshot.{name}"), default if default is not None else _or(score, 0.0)), low, high) for name, default, low, high in SNAPSHOT]
    return [*found, sign, clamp(alignment(sign, found[3]), -1.0, 1.0)]


def _rebuilt(v: Column, score: Column, sign: Column) -> list[Column]:
    """The vector of a row without a snapshot, from its other blocks."""
    get = lambda path: number(v, f"$.{path}")
    first = lambda *paths: F.coalesce(*[F.when(F.try_variant_get(v, f"$.{p}", "string").isNotNull(), _or(get(p), 0.0)) for p in paths])
    trend = F.abs(F.coalesce(get("direction_agg.strength.all"), get("direction_agg.strength"), F.lit(0.0)))
    confidence = F.coalesce(*[F.when(F.try_variant_get(v, f"$.direction_agg.{p}", "string").isNotNull(), _or(get(f"direction_agg.{p}"), 0.5)) for p in ("direction_confidence_calibrated", "direction_confidence")], F.lit(0.5))
    spread = F.coalesce(*[F.when(F.try_variant_get(v, f"$.cost_model.{p}", "string").isNotNull(), _or(get(f"cost_model.{p}"), 8.0)) for p in ("spread_bps", "total_cost_bps")], F.lit(8.0))
    funding = first(*[f"funding.{p}" for p in ("expected_funding_bps", "directional_funding_bps_per_event", "directional_funding_bps_interval", "directional_funding_bps_8h", "carry_cost_bps_8h")])
    tier = F.lower(_or(F.try_variant_get(v, "$.liquidity.tier", "string"), F.lit("medium")))
    sentiment = _or(get("effective_sentiment"), 0.0)
    return [
        clamp(F.greatest(F.lit(0.0), 1 - trend)), clamp(trend), clamp(_or(factor(v, "atr_pct"), 0.0) / 0.10, 0.0, 2.0), clamp(sentiment, -1.0, 1.0), clamp(confidence), clamp(_or(get("direction_agg.coherence"), 0.5)),
        clamp(spread / 10.0, 0.0, 5.0), clamp(_or(score, 0.0), -1.0, 1.0), clamp(_or(get("open_interest.oi_4h_chg_pct"), 0.0) / 10.0, -3.0, 3.0), clamp(_or(funding, 0.0) / 20.0, -2.0, 2.0),
        F.coalesce(*[F.when(tier == name, F.lit(x)) for name, x in TIERS.items()], F.lit(0.67)), clamp(_or(get("btc_beta.correlation"), 0.0), -1.0, 1.0), clamp(_or(get("direction_agg.regime_confidence"), 0.5)), sign, clamp(alignment(sign, sentiment), -1.0, 1.0),
    ]


def features(reasons: Column, score: Column, direction: Column) -> tuple[Column, Column]:
    """(vector of 15 numbers, reject code): one of them is null.

    ``reasons`` is a variant (:func:`variant`); make it a column first, as it is
    read many times. Codes: NO_SCORE, NO_REASONS (missing, malformed, no object),
    DIRECTION_SIGN_MISMATCH and SENTIMENT_ALIGNMENT_MISMATCH (a snapshot at odds
    with its row).
    """
    sign, sentiment = direction_sign(direction), clamp(_or(number(reasons, "$.feature_snapshot.effective_sentiment"), 0.0), -1.0, 1.0)
    kind = F.schema_of_variant(F.try_variant_get(reasons, "$.feature_snapshot", "variant"))
    has = F.coalesce(kind.startswith("OBJECT") & (kind != "OBJECT<>"), F.lit(False))
    off = lambda path, want: has & there(reasons, f"$.feature_snapshot.{path}") & ~F.coalesce(F.abs(number(reasons, f"$.feature_snapshot.{path}") - want) <= 1e-12, F.lit(False))
    code = F.when(score.isNull(), "NO_SCORE").when(reasons.isNull(), "NO_REASONS").when(off("direction_sign", sign), "DIRECTION_SIGN_MISMATCH").when(off("sentiment_alignment", alignment(sign, sentiment)), "SENTIMENT_ALIGNMENT_MISMATCH")
    score = finite(score.cast("double"))
    return F.when(code.isNull(), F.when(has, F.array(*_from_snapshot(reasons, score, sign))).otherwise(F.array(*_rebuilt(reasons, score, sign)))), code

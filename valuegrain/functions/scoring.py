"""Row expressions around a predicted value: segment, confidence, cost, interval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuegrain.schema import GROWTH, HIGH, LOW

# Fixed values.
HIGH_FROM, GROWTH_FROM = 500, 150
CAC_SHARE, CAC_CEILING = 0.3, 0.5
INTERVAL_Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
DEFAULT_Z = 1.96
FALLBACK_SPREAD = 0.25


def value_segment(value: Column) -> Column:
    return (
        F.when(value >= HIGH_FROM, HIGH).when(value >= GROWTH_FROM, GROWTH).otherwise(LOW)
    )


def prediction_confidence(value: Column) -> Column:
    """Confidence of a stored prediction."""
    return F.when(value > 1000, "High").when(value > 300, "Medium").otherwise("Low")


def request_confidence(value: Column) -> Column:
    """Confidence of a scored request; follows the segment limits instead."""
    return (
        F.when(value >= HIGH_FROM, "High").when(value >= GROWTH_FROM, "Medium").otherwise("Low")
    )


def recommended_cac(value: Column) -> Column:
    return F.round(value * CAC_SHARE, 2)


def response_cac(value: Column) -> Column:
    """Recommended cost as a response carries it, never above half the value."""
    return F.least(recommended_cac(value), value * CAC_CEILING)


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def heuristic_value(
    spent: Column, orders: Column, idle_days: Column, email: Column, returns: Column
) -> Column:
    """Model-free value estimate in whole units; absent rates count as zero."""
    base = spent * 1.5
    base = base * (1 + F.coalesce(email, F.lit(0.0)))
    base = base * (1 - F.coalesce(returns, F.lit(0.0)))
    base = base * (1 + orders * 0.05)
    base = F.when(idle_days < 30, base * 1.2).when(idle_days > 90, base * 0.8).otherwise(base)
    return half_up(base).cast("double")


def interval_columns(
    value: Column, members: list[Column], confidence: float = 0.95
) -> dict[str, Column]:
    """Prediction interval from the disagreement of the member predictions.

    With fewer than two members the spread is assumed to be a quarter of the value.
    """
    count = len(members)
    if count < 2:
        deviation = value * FALLBACK_SPREAD
        lower = F.greatest(value - deviation, F.lit(0.0))
        upper = value + deviation
        score, category = F.lit(0.5), F.lit("Medium")
    else:
        mean = reduce(Column.__add__, members) / count
        squares = [(m - mean) * (m - mean) for m in members]
        deviation = F.sqrt(reduce(Column.__add__, squares) / count)
        margin = deviation * INTERVAL_Z.get(confidence, DEFAULT_Z)
        lower = F.greatest(value - margin, F.lit(0.0))
        upper = value + margin
        relative = F.when(value != 0, F.try_divide(deviation, F.abs(value))).otherwise(1.0)
        score = F.least(relative, F.lit(1.0))
        category = (
            F.when(relative < 0.1, "Very High")
            .when(relative < 0.2, "High")
            .when(relative < 0.4, "Medium")
            .otherwise("Low")
        )
    none = F.lit(None).cast("double")
    least = F.least(*members) if count > 1 else (members[0] if members else none)
    most = F.greatest(*members) if count > 1 else (members[0] if members else none)
    return {
        "interval_level": F.lit(confidence),
        "interval_lower": lower,
        "interval_upper": upper,
        "interval_margin": upper - value,
        "uncertainty_score": score,
        "uncertainty_category": category,
        "uncertainty_std": deviation,
        "uncertainty_variance": deviation * deviation,
        "member_count": F.lit(count),
        "member_min": least,
        "member_max": most,
        "member_spread": most - least if count > 1 else none,
    }

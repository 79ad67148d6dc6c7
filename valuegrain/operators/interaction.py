"""Features that combine columns of the other families."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.functions import lookups
from valuegrain.operators.profile import Profile

COMPOSITE_PARTS = ("rfm_weighted", "engagement_score", "purchase_velocity", "cac_efficiency")
SPAN_FLOOR = 1e-10

# name: factors
PRODUCTS = {
    "engaged_value_score": ("engagement_score", "monetary_normalized"),
    "rf_score": ("recency_normalized", "frequency_normalized"),
    "mature_value_score": ("customer_maturity", "monetary_normalized"),
    "source_value_score": ("source_quality_score", "monetary_normalized"),
}


def fit_spans(df: DataFrame, profile: Profile) -> None:
    """Learn the range of each part of the composite score; one scan."""
    parts = [c for c in COMPOSITE_PARTS if c in df.columns]
    if len(parts) < 2:
        return
    row = df.agg(
        *[F.min(c).alias(f"{c}:min") for c in parts],
        *[F.max(c).alias(f"{c}:max") for c in parts],
    ).first()
    for c in parts:
        if row[f"{c}:min"] is not None:
            profile.spans[c] = [float(row[f"{c}:min"]), float(row[f"{c}:max"])]


def interaction_columns(available: Iterable[str], profile: Profile) -> list[dict[str, Column]]:
    available = set(available)
    out: dict[str, Column] = {}

    def relative(column: str) -> Column:
        return F.try_divide(F.col(column), F.lit(profile.median(column)).cast("double"))

    if {"total_spent", "total_orders", "avg_order_value"} <= available:
        out["value_frequency_score"] = relative("avg_order_value") * F.log1p("total_orders")
    for name, (left, right) in PRODUCTS.items():
        if {left, right} <= available:
            out[name] = F.col(left) * F.col(right)
    parts = [c for c in COMPOSITE_PARTS if c in available and c in profile.spans]
    if len(parts) >= 2:
        out["clv_predictor_composite"] = _mean_present(
            [(F.col(c) - F.lit(low)) / F.lit(high - low + SPAN_FLOOR)
             for c, (low, high) in ((c, profile.spans[c]) for c in parts)]
        )
    if {"acquisition_source", "num_categories"} <= available:
        order = lookups.source_order(F.col("acquisition_source"))
        out["source_numeric"] = order
        out["source_category_interaction"] = order * F.col("num_categories")
    if {"campaign_type", "total_spent"} <= available:
        order = lookups.campaign_order(F.col("campaign_type"))
        out["campaign_numeric"] = order
        out["campaign_value_interaction"] = order * relative("total_spent")
    if {"first_purchase_quarter", "total_orders"} <= available:
        out["quarter_frequency_interaction"] = F.col("first_purchase_quarter") * F.log1p(
            "total_orders"
        )
    if {"first_purchase_season", "avg_order_value"} <= available:
        out["season_value_interaction"] = F.col("first_purchase_season") * relative(
            "avg_order_value"
        )
    if {"email_engagement_rate", "days_since_last_purchase"} <= available:
        oldest = profile.maxima.get("days_since_last_purchase") or 0
        freshness = (
            1 - F.col("days_since_last_purchase") / F.lit(float(oldest))
            if oldest > 0
            else F.lit(0.0)
        )
        out["engagement_recency_interaction"] = F.col("email_engagement_rate") * freshness
    return [out]


def _mean_present(columns: list[Column]) -> Column:
    """Mean over the non-null columns of a row."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, present)

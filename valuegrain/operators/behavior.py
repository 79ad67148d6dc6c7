"""Behavioural features: velocity, timing, engagement, tenure and churn risk."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuegrain.functions.bins import flag, right_closed
from valuegrain.operators.profile import Profile

# Fixed values.
DAYS_PER_MONTH = 30.44
DAYS_PER_YEAR = 365.25
EMAIL_EDGES, EMAIL_TIERS = (0, 0.2, 0.4, 0.6, 0.8), (1, 2, 3, 4, 5)
TENURE_EDGES, TENURE_TIERS = (0, 30, 90, 180, 365, 730), (1, 2, 3, 4, 5, 6)


def behavior_columns(available: Iterable[str], profile: Profile) -> list[dict[str, Column]]:
    available = set(available)
    out: dict[str, Column] = {}
    derived: dict[str, Column] = {}
    orders, spent = F.col("total_orders"), F.col("total_spent")
    first, last = F.col("days_since_first_purchase"), F.col("days_since_last_purchase")
    aov, email, returns = (
        F.col("avg_order_value"),
        F.col("email_engagement_rate"),
        F.col("return_rate"),
    )
    months = _at_least(first / DAYS_PER_MONTH, 0.5)
    weeks = _at_least(first / 7, 1.0)

    if {"total_orders", "days_since_first_purchase"} <= available:
        out["purchase_velocity"] = orders / months
        out["orders_per_week"] = orders / weeks
        if "days_since_last_purchase" in available:
            elapsed = F.try_divide(last, first)
            out["recency_ratio"] = F.when(first > 0, 1 - elapsed).otherwise(0.0)
        gap = F.try_divide(first, orders - 1)
        out["avg_days_between_purchases"] = F.when(orders > 1, gap).otherwise(
            first.cast("double")
        )
        spacing = F.col("avg_days_between_purchases")
        derived["purchase_regularity"] = F.when(spacing > 0, 1 / (1 + spacing / 30)).otherwise(
            0.0
        )
    if {"total_spent", "total_orders"} <= available:
        if "days_since_first_purchase" in available:
            out["spending_velocity"] = spent / months
        if "avg_order_value" in available:
            middle = F.lit(profile.median("avg_order_value")).cast("double")
            out["aov_deviation"] = F.try_divide(F.abs(aov - middle), middle)
    if "email_engagement_rate" in available:
        # Rates above one lie outside every tier.
        out["email_engagement_bucket"] = F.when(
            email <= 1, right_closed(email, EMAIL_EDGES, EMAIL_TIERS)
        )
    if "return_rate" in available:
        out["is_returner"] = flag(returns > 0.1)
        out["return_risk"] = F.when(returns > 0.3, 2).when(returns > 0.15, 1).otherwise(0)
    if {"email_engagement_rate", "return_rate"} <= available:
        out["engagement_score"] = email * 0.6 + (1 - returns) * 0.4
    if "days_since_first_purchase" in available:
        out["tenure_days"] = first
        out["tenure_months"] = first / DAYS_PER_MONTH
        out["tenure_years"] = first / DAYS_PER_YEAR
        out["tenure_bucket"] = right_closed(first, TENURE_EDGES, TENURE_TIERS)
        out["customer_maturity"] = _at_most_one(first / 365)
    if "num_categories" in available:
        categories = F.col("num_categories")
        out["is_multi_category"] = flag(categories >= 3)
        out["category_diversity"] = _at_most_one(categories / 5)
    if "avg_order_value" in available:
        for name, share in (("is_high_aov", 0.75), ("is_premium", 0.9)):
            level = F.lit(profile.quantile("avg_order_value", share)).cast("double")
            out[name] = flag(aov >= level)
    if "days_since_last_purchase" in available:
        mean = F.lit(profile.means.get("days_since_last_purchase")).cast("double")
        sd = F.lit(profile.deviations.get("days_since_last_purchase")).cast("double")
        out["churn_risk_score"] = (
            F.when(last > mean + 2 * sd, 3)
            .when(last > mean + sd, 2)
            .when(last > mean, 1)
            .otherwise(0)
        )
        derived["is_at_risk"] = flag(F.col("churn_risk_score") >= 2)
    return [out, derived]


def _at_least(column: Column, low: float) -> Column:
    """Lower bound that keeps nulls, which ``greatest`` would replace."""
    return F.when(column < low, F.lit(low)).otherwise(column)


def _at_most_one(column: Column) -> Column:
    return F.when(column > 1, 1.0).otherwise(column)

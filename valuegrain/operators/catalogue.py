"""Catalogue of the registered features by family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.session import constant_table

# Registered feature names by category.
CATALOGUE = {
    "rfm": (
        "recency_score recency_normalized frequency_score frequency_log "
        "frequency_normalized monetary_score monetary_log monetary_normalized "
        "rfm_score rfm_weighted"
    ).split(),
    "behavioral": (
        "purchase_velocity orders_per_week recency_ratio avg_days_between_purchases "
        "purchase_regularity spending_velocity aov_deviation email_engagement_bucket "
        "is_returner return_risk engagement_score tenure_months tenure_bucket "
        "customer_maturity is_multi_category category_diversity is_high_aov is_premium "
        "churn_risk_score is_at_risk"
    ).split(),
    "temporal": (
        "first_purchase_dow first_purchase_month first_purchase_quarter "
        "first_purchase_is_weekend first_purchase_season last_purchase_dow "
        "last_purchase_month purchased_last_7d purchased_last_30d purchased_last_90d "
        "inactive_180d days_to_major_holiday is_peak_season near_any_holiday"
    ).split(),
    "statistical": (
        "total_spent_zscore total_spent_percentile total_spent_is_outlier "
        "total_orders_zscore total_orders_percentile total_orders_is_outlier "
        "avg_order_value_zscore avg_order_value_percentile avg_order_value_is_outlier "
        "outlier_score"
    ).split(),
    "acquisition": (
        "source_quality_score is_paid_acquisition is_organic is_referral "
        "campaign_effectiveness is_retargeted cac_efficiency cac_roi cac_paid_back"
    ).split(),
    "interaction": (
        "value_frequency_score engaged_value_score rf_score mature_value_score "
        "source_value_score clv_predictor_composite source_category_interaction "
        "campaign_value_interaction quarter_frequency_interaction "
        "season_value_interaction engagement_recency_interaction"
    ).split(),
}


def feature_catalogue(spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
    """One row per registered feature; ``columns`` keeps those present in a table."""
    rows = [(name, category) for category, names in CATALOGUE.items() for name in names]
    table = constant_table(spark, rows, "feature category")
    return table if columns is None else table.where(F.col("feature").isin(columns))


def feature_names(category: str | None = None) -> list[str]:
    if category is not None:
        return list(CATALOGUE[category])
    return [name for names in CATALOGUE.values() for name in names]


def feature_summary(catalogue: DataFrame) -> DataFrame:
    """Registered features per category."""
    return catalogue.groupBy("category").count().withColumnRenamed("count", "features")

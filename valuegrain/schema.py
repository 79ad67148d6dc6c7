"""Canonical customer table: types, contract limits and fixed vocabularies."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

ID = "customer_id"

CUSTOMER_SCHEMA = T.StructType(
    [
        T.StructField(ID, T.StringType()),
        T.StructField("first_purchase_date", T.DateType()),
        T.StructField("last_purchase_date", T.DateType()),
        T.StructField("total_orders", T.LongType()),
        T.StructField("total_spent", T.DoubleType()),
        T.StructField("avg_order_value", T.DoubleType()),
        T.StructField("days_since_first_purchase", T.IntegerType()),
        T.StructField("days_since_last_purchase", T.IntegerType()),
        T.StructField("product_categories", T.ArrayType(T.StringType())),
        T.StructField("num_categories", T.IntegerType()),
        T.StructField("acquisition_source", T.StringType()),
        T.StructField("campaign_type", T.StringType()),
        T.StructField("acquisition_cost", T.DoubleType()),
        T.StructField("email_engagement_rate", T.DoubleType()),
        T.StructField("return_rate", T.DoubleType()),
        T.StructField("customer_segment", T.StringType()),
        T.StructField("actual_clv", T.DoubleType()),
    ]
)


class Limit(NamedTuple):
    """Inclusive contract range; ``default`` is used for absent values."""

    low: float
    high: float
    default: float | None = None


# Fixed values of the row contract.
LIMITS = {
    "total_orders": Limit(0, 10_000),
    "total_spent": Limit(0, 10_000_000),
    "avg_order_value": Limit(0, 100_000),
    "days_since_first_purchase": Limit(0, 3_650),
    "days_since_last_purchase": Limit(0, 3_650),
    "num_categories": Limit(1, 20, 1),
    "acquisition_cost": Limit(0, 10_000, 0),
    "email_engagement_rate": Limit(0, 1, 0),
    "return_rate": Limit(0, 1, 0),
}
ID_PATTERN = "^[A-Za-z0-9_-]+$"
ID_MAX_LENGTH = 50
MAX_BUDGET = 10_000_000
MAX_PAGE_SIZE = 1000

HIGH, GROWTH, LOW = "High-CLV", "Growth-Potential", "Low-CLV"
SEGMENTS = (HIGH, GROWTH, LOW)
SOURCES = ("Meta Ads", "Google Ads", "Email", "Direct", "Organic", "Referral")
CAMPAIGNS = ("Prospecting", "Retargeting", "Brand", "None")
VOCABULARIES = {
    "acquisition_source": SOURCES,
    "campaign_type": CAMPAIGNS,
    "customer_segment": SEGMENTS,
}
CONTRACT_DEFAULTS = {"acquisition_source": "Direct", "campaign_type": "None"}

# Columns that never enter a feature matrix.
NON_FEATURES = (
    ID,
    "first_purchase_date",
    "last_purchase_date",
    "product_categories",
    "customer_segment",
    "actual_clv",
)


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType)]


def string_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.StringType)]

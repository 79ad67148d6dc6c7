"""Fixed lookup tables of the acquisition and calendar features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuegrain.functions.bins import lookup

# Fixed values.
SOURCE_QUALITY = {
    "Referral": 0.95,
    "Email": 0.85,
    "Organic": 0.80,
    "Google Ads": 0.75,
    "Meta Ads": 0.70,
    "Direct": 0.65,
}
CAMPAIGN_EFFECT = {
    "Retargeting": 0.85,
    "Brand": 0.75,
    "Prospecting": 0.65,
    "None": 0.50,
}
SOURCE_ORDER = {
    "Referral": 5,
    "Email": 4,
    "Organic": 3,
    "Direct": 2,
    "Meta Ads": 1,
    "Google Ads": 1,
}
CAMPAIGN_ORDER = {"Retargeting": 3, "Brand": 2, "Prospecting": 1, "None": 0}
PAID_SOURCES = ("Meta Ads", "Google Ads")
ORGANIC_SOURCES = ("Organic", "Direct", "Referral")


def source_quality(source: Column) -> Column:
    return lookup(source, SOURCE_QUALITY, 0.5)


def campaign_effect(campaign: Column) -> Column:
    return lookup(campaign, CAMPAIGN_EFFECT, 0.5)


def source_order(source: Column) -> Column:
    return lookup(source, SOURCE_ORDER, 2)


def campaign_order(campaign: Column) -> Column:
    return lookup(campaign, CAMPAIGN_ORDER, 0)


def season(day: Column) -> Column:
    """1 winter (December to February), 2 spring, 3 summer, 4 autumn."""
    return F.floor(F.month(day) % 12 / 3).cast("int") + 1

"""Acquisition channel, campaign and cost features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuegrain.functions import lookups
from valuegrain.functions.bins import flag
from valuegrain.operators.profile import Profile


def acquisition_columns(available: Iterable[str], profile: Profile) -> list[dict[str, Column]]:
    available = set(available)
    out: dict[str, Column] = {}
    if "acquisition_source" in available:
        source = F.col("acquisition_source")
        out["source_quality_score"] = lookups.source_quality(source)
        out["is_paid_acquisition"] = flag(source.isin(*lookups.PAID_SOURCES))
        out["is_organic"] = flag(source.isin(*lookups.ORGANIC_SOURCES))
        out["is_referral"] = flag(source == "Referral")
    if "campaign_type" in available:
        campaign = F.col("campaign_type")
        out["campaign_effectiveness"] = lookups.campaign_effect(campaign)
        out["is_retargeted"] = flag(campaign == "Retargeting")
        out["is_prospecting"] = flag(campaign == "Prospecting")
    if "acquisition_cost" in available:
        cost = F.col("acquisition_cost")
        out["has_cac"] = flag(cost > 0)
        if "total_spent" in available:
            spent = F.col("total_spent")
            typical = F.lit(profile.median("total_spent")).cast("double")
            out["cac_efficiency"] = F.when(cost > 0, F.try_divide(spent, cost)).otherwise(typical)
            out["cac_roi"] = F.when(cost > 0, F.try_divide(spent - cost, cost)).otherwise(0.0)
            out["cac_paid_back"] = flag(spent > cost)
    return [out]

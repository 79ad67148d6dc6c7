"""Fit a feature plan on a customer table and apply it as projections."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from valuegrain.operators.acquisition import acquisition_columns
from valuegrain.operators.behavior import behavior_columns
from valuegrain.operators.calendar import holiday_columns, temporal_columns
from valuegrain.operators.clean import fill_numeric_gaps
from valuegrain.operators.interaction import COMPOSITE_PARTS, fit_spans, interaction_columns
from valuegrain.operators.order_stats import SAMPLE_ROWS
from valuegrain.operators.profile import EDGE_STEPS, Profile, fit_profile
from valuegrain.operators.rfm import rfm_columns
from valuegrain.operators.statistical import add_statistical

FAMILIES = (
    "rfm",
    "behavioral",
    "temporal",
    "statistical",
    "acquisition",
    "interaction",
    "holiday",
)


@dataclass
class FeaturePlan:
    """Feature families over fitted population statistics.

    Scoring new rows reuses the statistics of the fitted table. All families are
    projections of the row itself; only exact percentile ranks compare rows.
    """

    profile: Profile
    method: str = "quantile"

    def transform(
        self,
        df: DataFrame,
        families: Iterable[str] = FAMILIES,
        *,
        exact_ranks: bool = False,
        fill: bool = True,
    ) -> DataFrame:
        families = set(families)
        unknown = families - set(FAMILIES)
        if unknown:
            raise ValueError(f"unknown feature families: {sorted(unknown)}")
        if "statistical" in families:
            df = add_statistical(df, self.profile, exact_ranks=exact_ranks)
        for family in FAMILIES:
            if family in families and family != "statistical":
                df = self._project(df, family)
        return fill_numeric_gaps(df) if fill else df

    def _project(self, df: DataFrame, family: str) -> DataFrame:
        have, profile = df.columns, self.profile
        layers = {
            "rfm": lambda: rfm_columns(have, profile, self.method),
            "behavioral": lambda: behavior_columns(have, profile),
            "temporal": lambda: temporal_columns(have),
            "acquisition": lambda: acquisition_columns(have, profile),
            "interaction": lambda: interaction_columns(have, profile),
            "holiday": lambda: holiday_columns(have),
        }[family]()
        for layer in layers:
            df = df.withColumns(layer) if layer else df
        return df


def fit_features(
    df: DataFrame,
    *,
    bins: int = 5,
    method: str = "quantile",
    sample_rows: int = SAMPLE_ROWS,
    edge_steps: int = EDGE_STEPS,
) -> FeaturePlan:
    """Three scans of ``df``: moments, order statistics, ranges of derived columns.

    Keep ``df`` cached or stored when it is expensive to build.
    """
    profile = fit_profile(df, bins=bins, sample_rows=sample_rows, edge_steps=edge_steps)
    plan = FeaturePlan(profile, method)
    parts = plan.transform(df, ("rfm", "behavioral", "acquisition"), fill=False)
    fit_spans(parts.select(*[c for c in COMPOSITE_PARTS if c in parts.columns]), profile)
    return plan

"""Recency, frequency and monetary features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuegrain.functions.bins import right_closed
from valuegrain.operators.profile import Profile
from valuegrain.schema import ID

# Fixed edges of the rule-based scores and the weights of the combined score.
RECENCY_EDGES = (-1, 7, 30, 90, 180)
FREQUENCY_EDGES = (-1, 1, 3, 6, 12)
MONETARY_EDGES = (-1, 50, 150, 400, 1000)
RECENCY_WEIGHT, FREQUENCY_WEIGHT, MONETARY_WEIGHT = 0.2, 0.35, 0.45

ASCENDING = (1, 2, 3, 4, 5)


def quantile_score(column: str, cuts: list, *, id_column: str = ID) -> Column:
    """Bin of a row in the (value, id) order, from the fitted cut keys alone.

    A row is in bin ``1 + number of cut keys it lies beyond``, so no row is ranked,
    moved or compared with another one.
    """
    value, row_id = F.col(column), F.col(id_column)
    score = F.lit(1.0)
    for cut_value, cut_id in cuts:
        beyond = (value > F.lit(cut_value)) | (
            (value == F.lit(cut_value)) & (row_id > F.lit(cut_id))
        )
        score = score + F.when(beyond, 1.0).otherwise(0.0)
    return F.when(value.isNotNull(), score)


def _fixed_score(column: str, edges, labels) -> Column:
    return F.coalesce(right_closed(F.col(column), edges, labels), F.lit(3.0))


def _normalized(column: str, profile: Profile, inverted: bool = False) -> Column:
    top = profile.maxima.get(column)
    if not top or top <= 0:
        return F.lit(1.0)
    share = F.col(column) / F.lit(float(top))
    return 1 - share if inverted else share


def rfm_columns(
    available: Iterable[str], profile: Profile, method: str = "quantile"
) -> list[dict[str, Column]]:
    """Column layers of the family; a layer may use the layers before it.

    ``method="fixed"`` uses the rule-based edges, as does a population smaller
    than the number of bins.
    """
    available = set(available)
    fixed = method == "fixed" or profile.rows < profile.bins
    first: dict[str, Column] = {}

    def score(column, edges, labels, reverse=False):
        if fixed or column not in profile.cuts:
            return _fixed_score(column, edges, labels)
        ascending = quantile_score(column, profile.cuts[column])
        return (profile.bins + 1) - ascending if reverse else ascending

    if "days_since_last_purchase" in available:
        c = "days_since_last_purchase"
        first["recency_score"] = score(c, RECENCY_EDGES, ASCENDING[::-1], reverse=True)
        first["recency_normalized"] = _normalized(c, profile, inverted=True)
    if "total_orders" in available:
        first["frequency_score"] = score("total_orders", FREQUENCY_EDGES, ASCENDING)
        first["frequency_log"] = F.log1p("total_orders")
        first["frequency_normalized"] = _normalized("total_orders", profile)
    if "total_spent" in available:
        first["monetary_score"] = score("total_spent", MONETARY_EDGES, ASCENDING)
        first["monetary_log"] = F.log1p("total_spent")
        first["monetary_normalized"] = _normalized("total_spent", profile)
    if not {"recency_score", "frequency_score", "monetary_score"} <= first.keys():
        return [first]

    r, f, m = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    digits = [c.cast("int").cast("string") for c in (r, f, m)]
    combined = {
        "rfm_score": r + f + m,
        "rfm_weighted": r * RECENCY_WEIGHT + f * FREQUENCY_WEIGHT + m * MONETARY_WEIGHT,
        "rfm_string": F.concat(*digits),
        "rfm_segment": rfm_segment(r, f, m),
    }
    return [first, combined]


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """Named group of a score triple; the first rule that holds wins.

    Three further names of the scheme ("At Risk", "Cannot Lose Them", "Lost") can
    never be reached behind these rules and are left out.
    """
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((f >= 4) & (m >= 4), "Loyal Customers")
        .when((r >= 4) & (f >= 3), "Potential Loyalists")
        .when((r >= 4) & (f <= 2), "Recent Customers")
        .when((r >= 3) & (f >= 2) & (m >= 2), "Promising")
        .when((r >= 2) & (f >= 3) & (m >= 3), "Need Attention")
        .when((r <= 2) & (f >= 2), "About to Sleep")
        .when((r <= 2) & (f <= 2), "Hibernating")
        .otherwise("Others")
    )

"""Cleaning: imputation, winsorising and range clipping, fitted then applied."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain import schema as S
from valuegrain.errors import NotEnoughData
from valuegrain.operators.order_stats import SAMPLE_ROWS, quantiles

MONEY_COLUMNS = ("total_spent", "avg_order_value", "actual_clv")
COUNT_COLUMNS = ("total_orders", "days_since_first_purchase", "days_since_last_purchase")
RATE_COLUMNS = ("email_engagement_rate", "return_rate")
TAIL_SHARES = (0.01, 0.99)
TAIL_REACH = 1.5


@dataclass
class Cleaning:
    """Scalars learnt from one table; applying them is a single projection."""

    fills: dict[str, float | str] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def impute(self, df: DataFrame) -> DataFrame:
        filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.fills.items()}
        return df.withColumns(filled) if filled else df

    def apply(self, df: DataFrame) -> DataFrame:
        df = self.impute(df)
        clipped = {}
        for name, (low, high) in self.bounds.items():
            if name in df.columns:
                clipped[name] = _clip(name, low, high)
        for name in COUNT_COLUMNS:
            if name in df.columns:
                zero = F.lit(0).cast(df.schema[name].dataType)
                clipped[name] = F.when(F.col(name) < 0, zero).otherwise(F.col(name))
        for name in RATE_COLUMNS:
            if name in df.columns:
                clipped[name] = _clip(name, 0.0, 1.0)
        return df.withColumns(clipped)


def _clip(name: str, low: float, high: float):
    column = F.col(name).cast("double")
    return F.when(column < low, F.lit(low)).when(column > high, F.lit(high)).otherwise(column)


def fit_cleaning(df: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Cleaning:
    """Learn medians, modes and tail bounds. Two scans, three when values are missing.

    Integer columns with gaps turn into doubles, since their median may be one.
    """
    numeric = S.numeric_columns(df.schema)
    text = [c for c in S.string_columns(df.schema) if c != S.ID]
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in numeric + text]
    ).first()
    gaps = [c for c in numeric + text if counted[c] < counted["rows"]]

    shares = {c: (0.5,) for c in gaps if c in numeric}
    sizes = {c: counted[c] for c in numeric}
    medians = quantiles(df, shares, sizes=sizes, sample_rows=sample_rows)
    cleaning = Cleaning()
    for name, by_share in medians.items():
        if by_share[0.5] is not None:
            cleaning.fills[name] = by_share[0.5]
    for name in gaps:
        if name in text:
            cleaning.fills[name] = _mode(df, name)

    filled = cleaning.impute(df)
    money = [c for c in MONEY_COLUMNS if c in df.columns]
    sizes = {c: counted["rows"] if c in cleaning.fills else counted[c] for c in money}
    tails = quantiles(
        filled, {c: TAIL_SHARES for c in money}, sizes=sizes, sample_rows=sample_rows
    )
    for name, by_share in tails.items():
        low, high = (by_share[s] for s in TAIL_SHARES)
        if low is not None:
            reach = TAIL_REACH * (high - low)
            cleaning.bounds[name] = (max(0.0, low - reach), high + reach)
    return cleaning


def _mode(df: DataFrame, name: str) -> str:
    """Most frequent value, the smallest among ties; "Unknown" if there is none."""
    top = (
        df.where(F.col(name).isNotNull())
        .groupBy(name)
        .count()
        .orderBy(F.desc("count"), name)
        .first()
    )
    return "Unknown" if top is None else top[name]


def fill_numeric_gaps(df: DataFrame) -> DataFrame:
    """Zero in every numeric gap; NaN counts as a gap."""
    return df.na.fill(0, S.numeric_columns(df.schema))


def present_gaps(df: DataFrame) -> DataFrame:
    """Show missing source and campaign as "None", as list and detail views do."""
    shown = {
        c: F.coalesce(F.col(c), F.lit("None"))
        for c in ("acquisition_source", "campaign_type")
        if c in df.columns
    }
    return df.withColumns(shown) if shown else df


def require_rows(df: DataFrame, required: int) -> None:
    """Refuse a table with fewer rows; stops counting at the required number."""
    available = df.limit(required).count()
    if available < required:
        raise NotEnoughData(required, available)

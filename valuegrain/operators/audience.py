"""Advertising audiences, cost bands, budgets, lookalikes and campaign setups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.operators.customers import segment_column
from valuegrain.operators.segments import every_segment
from valuegrain.schema import GROWTH, HIGH, LOW, MAX_BUDGET
from valuegrain.session import constant_table

TARGET_RATIO, CEILING_RATIO, FLOOR_RATIO = 0.30, 0.40, 0.15

# Fixed texts and weights per segment.
BUDGET_WEIGHTS = {HIGH: 0.50, GROWTH: 0.35, LOW: 0.15}
TARGETING = [
    (HIGH, "Primary", "1% Lookalike - Best for prospecting", "Target Cost / Value Optimization"),
    (
        GROWTH,
        "Secondary",
        "2-3% Lookalike - Broader reach",
        "Lowest Cost with Conversion Optimization",
    ),
    (LOW, "Tertiary", "5%+ Lookalike - Testing only", "Strict Cost Caps"),
]
LOOKALIKES = [
    (
        "prospecting",
        "High-CLV",
        [HIGH],
        "1%",
        "500K - 1M",
        "Highest",
        "Use for new customer acquisition with value optimization",
    ),
    (
        "expansion",
        "High-CLV + Growth-Potential",
        [HIGH, GROWTH],
        "2-3%",
        "1M - 2M",
        "Medium",
        "Use for broader reach with conversion optimization",
    ),
    (
        "testing",
        "Growth-Potential",
        [GROWTH],
        "3-5%",
        "2M - 5M",
        "Lower",
        "Use for testing new markets with lowest cost bidding",
    ),
]
CAMPAIGNS = [
    (
        HIGH,
        "Conversions",
        "Purchase",
        "Highest Value or Target ROAS",
        "CBO (Campaign Budget Optimization)",
        "Video (60+ seconds), Carousel",
        "Premium positioning, quality focus, lifestyle",
        "180 days",
        "No cap / High tolerance",
    ),
    (
        GROWTH,
        "Conversions",
        "Purchase",
        "Lowest Cost",
        "CBO",
        "Carousel, Single Image",
        "Value proposition, benefits, social proof",
        "90 days",
        "3-5 per week",
    ),
    (
        LOW,
        "Conversions",
        "Add to Cart or Purchase",
        "Cost Cap",
        "ABO (Ad Set Budget)",
        "Single Image",
        "Price focus, urgency, discounts",
        "30 days",
        "2 per week",
    ),
]


def targeting_table(spark: SparkSession) -> DataFrame:
    fields = "segment targeting_priority lookalike_recommendation bidding_strategy"
    return constant_table(spark, TARGETING, fields)


def campaign_table(spark: SparkSession) -> DataFrame:
    fields = (
        "segment campaign_objective optimization_event bidding_strategy budget_type "
        "ad_format messaging retargeting_window frequency_cap"
    )
    return constant_table(spark, CAMPAIGNS, fields)


def audiences(df: DataFrame) -> DataFrame:
    """Customers of the three segments with targeting advice; the advice has three rows."""
    label = segment_column(df)
    if label is None:
        raise ValueError("no segment column found")
    advice = F.broadcast(targeting_table(df.sparkSession))
    return df.join(advice, F.col(label) == F.col("segment")).drop("segment")


def cac_band(value: Column, ratio: float | None = None) -> dict[str, Column]:
    """Cost band of a value; a zero or absent ratio means the default one."""
    ratio = ratio or TARGET_RATIO
    return {
        "predicted_clv": F.round(value, 2),
        "optimal_cac": F.round(value * ratio, 2),
        "cac_ratio": F.lit(ratio),
        "max_cac": F.round(value * CEILING_RATIO, 2),
        "min_cac": F.round(value * FLOOR_RATIO, 2),
        "expected_roas": F.round(F.lit(1 / ratio), 2),
    }


def _sized(df: DataFrame) -> DataFrame:
    """Customers and mean value of each segment, all three present."""
    label = segment_column(df)
    value = next((c for c in ("predicted_clv", "actual_clv") if c in df.columns), None)
    mean = F.avg(value) if value else F.lit(0.0)
    grouped = df.groupBy(F.col(label).alias("segment")).agg(
        F.count(F.lit(1)).alias("held"), mean.alias("mean_value")
    )
    return every_segment(df, grouped).select(
        "segment",
        F.coalesce("held", F.lit(0)).alias("customer_count"),
        F.coalesce("mean_value", F.lit(0.0)).alias("mean_value"),
    )


def budget_allocation(df: DataFrame, budget: float) -> DataFrame:
    """Budget, affordable acquisitions and expected return of each segment."""
    if not 0 < budget <= MAX_BUDGET:
        raise ValueError(f"budget must lie in (0, {MAX_BUDGET}]")
    weight = F.lit(0.0)
    for name, share in BUDGET_WEIGHTS.items():
        weight = F.when(F.col("segment") == name, share).otherwise(weight)
    mean = F.col("mean_value")
    cost = F.when(mean > 0, mean * TARGET_RATIO).otherwise(0.0)
    spend = weight * budget
    bought = F.when(cost > 0, F.floor(F.try_divide(spend, cost))).otherwise(0)
    revenue = bought * mean
    return _sized(df).select(
        "segment",
        F.round(spend, 2).alias("budget"),
        F.round(weight * 100, 1).alias("budget_percentage"),
        "customer_count",
        F.round(mean, 2).alias("avg_predicted_clv"),
        F.round(cost, 2).alias("optimal_cac"),
        bought.alias("expected_acquisitions"),
        F.round(revenue, 2).alias("expected_revenue"),
        F.round(revenue / spend, 2).alias("expected_roas"),
    )


def budget_totals(allocation: DataFrame, budget: float) -> DataFrame:
    """Totals over the allocated segments; revenue adds up the rounded amounts."""
    revenue = F.sum("expected_revenue")
    return allocation.agg(
        F.lit(float(budget)).alias("total_budget"),
        F.sum("expected_acquisitions").alias("total_expected_acquisitions"),
        F.round(revenue, 2).alias("total_expected_revenue"),
        F.round(revenue / budget, 2).alias("blended_roas"),
    )


def lookalike_plan(df: DataFrame) -> DataFrame:
    """Source audience sizes of the lookalike campaigns, counted in one scan."""
    label = F.col(segment_column(df))
    counted = df.agg(
        *[F.count_if(label.isin(*plan[2])).alias(plan[0]) for plan in LOOKALIKES]
    )
    entries = [
        F.struct(
            F.lit(name).alias("campaign"),
            F.lit(audience).alias("source_audience"),
            F.col(name).alias("source_size"),
            F.lit(size).alias("lookalike_size"),
            F.lit(reach).alias("estimated_reach"),
            F.lit(priority).alias("priority"),
            F.lit(strategy).alias("strategy"),
        )
        for name, audience, _, size, reach, priority, strategy in LOOKALIKES
    ]
    return counted.select(F.inline(F.array(*entries)))


def campaign_plan(df: DataFrame) -> DataFrame:
    """Campaign setup of each segment with its audience size."""
    sizes = _sized(df).select("segment", "customer_count")
    return F.broadcast(campaign_table(df.sparkSession)).join(sizes, "segment")


def audience_sizes(df: DataFrame) -> DataFrame:
    return _sized(df).select("segment", "customer_count")


def full_strategy(df: DataFrame, budget: float) -> dict[str, DataFrame]:
    """Every advertising table of a scored customer table by name."""
    allocation = budget_allocation(df, budget)
    return {
        "audiences": audiences(df),
        "budget_allocation": allocation,
        "budget_totals": budget_totals(allocation, budget),
        "lookalikes": lookalike_plan(df),
        "campaigns": campaign_plan(df),
        "audience_sizes": audience_sizes(df),
    }


def tidy_strategy(df: DataFrame, budget: float) -> DataFrame:
    """The whole strategy as one table: section, subject, field, amount, text.

    The budget, lookalike and campaign tables and the audience sizes, a row for each of their
    cells; numbers are amounts, all else is text.
    """
    tables = full_strategy(df, budget)
    keys = {"budget_allocation": "segment", "lookalikes": "campaign", "campaigns": "segment", "audience_sizes": "segment"}
    parts = [_cells(section, tables[section], key) for section, key in keys.items()]
    totals = tables["budget_totals"].withColumn("subject", F.lit("all"))
    whole = _cells("budget_totals", totals, "subject")
    for part in parts:
        whole = whole.unionByName(part)
    return whole


def _cells(section: str, table: DataFrame, key: str) -> DataFrame:
    cells = []
    for f in table.schema:
        if f.name == key:
            continue
        number = isinstance(f.dataType, T.NumericType)
        amount = F.col(f.name).cast("double") if number else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if number else F.col(f.name).cast("string")
        cells.append(F.struct(F.lit(f.name).alias("field"), amount.alias("amount"), text.alias("text")))
    return table.select(F.lit(section).alias("section"), F.col(key).alias("subject"), F.inline(F.array(*cells)))

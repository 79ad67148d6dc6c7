"""Dashboard aggregates over a scored customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain.operators.customers import segment_column, value_column
from valuegrain.schema import HIGH

# Fixed bucket names and their lower limits.
HISTOGRAM = (
    ("$0-100", None),
    ("$100-250", 100),
    ("$250-500", 250),
    ("$500-1000", 500),
    ("$1000+", 1000),
)


def dashboard_kpis(df: DataFrame) -> DataFrame:
    value, label = value_column(df), segment_column(df)
    rows = F.count(F.lit(1))
    high = F.count_if(F.col(label) == HIGH)
    return df.agg(
        rows.alias("total_customers"),
        F.avg(value).alias("avg_clv"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total_value"),
        F.coalesce(F.try_divide(high * 100.0, rows), F.lit(0.0)).alias("high_clv_percentage"),
    )


def _value_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias(name))
        .agg(F.count(F.lit(1)).alias("customers"))
    )


def segment_distribution(df: DataFrame) -> DataFrame:
    return _value_counts(df, segment_column(df), "segment")


def source_distribution(df: DataFrame) -> DataFrame:
    return _value_counts(df, "acquisition_source", "acquisition_source")


def value_histogram(df: DataFrame) -> DataFrame:
    """Customers per value bucket, empty buckets included; one scan, no join."""
    value = F.col(value_column(df))
    place = F.when(value < HISTOGRAM[1][1], 0)
    for i, (_, low) in enumerate(HISTOGRAM[1:], start=1):
        upper = HISTOGRAM[i + 1][1] if i + 1 < len(HISTOGRAM) else None
        inside = value >= low if upper is None else (value >= low) & (value < upper)
        place = place.when(inside, i)
    counted = df.select(place.alias("place")).agg(
        *[F.count_if(F.col("place") == i).alias(f"held_{i}") for i in range(len(HISTOGRAM))]
    )
    entries = [
        F.struct(F.lit(name).alias("bucket"), F.col(f"held_{i}").alias("customers"))
        for i, (name, _) in enumerate(HISTOGRAM)
    ]
    return counted.select(F.inline(F.array(*entries)))

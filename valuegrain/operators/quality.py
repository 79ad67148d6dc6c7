"""Data quality report as tidy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain import schema as S
from valuegrain.operators.order_stats import SAMPLE_ROWS, quantiles

UNCOUNTED_TEXT = (S.ID, "product_categories")


def quality_overview(df: DataFrame) -> DataFrame:
    """Rows, columns and fully repeated rows.

    Repeats are counted per distinct row with map-side combining, so a row repeated
    very often does not gather anywhere.
    """
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_records"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
    )


def quality_missing(df: DataFrame) -> DataFrame:
    """Missing values and their percentage per column; one scan."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{i}") for i, c in enumerate(df.columns)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"missing_{i}").alias("missing_values"),
            F.try_divide(F.col(f"missing_{i}") * 100.0, F.col("rows")).alias(
                "missing_percentage"
            ),
        )
        for i, c in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*entries)))


def quality_numeric(df: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Minimum, maximum, mean, exact median and sample deviation per numeric column."""
    numeric = S.numeric_columns(df.schema)
    medians = quantiles(df, {c: (0.5,) for c in numeric}, sample_rows=sample_rows)
    aggregates = []
    for c in numeric:
        aggregates.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                F.avg(c).alias("mean"),
                F.lit(medians[c][0.5]).cast("double").alias("median"),
                F.stddev_samp(c).alias("std"),
            ).alias(c)
        )
    return df.agg(*aggregates).select(F.inline(F.array(*[F.col(c) for c in numeric])))


def quality_categorical(df: DataFrame) -> DataFrame:
    """Value counts of every text column but the id, in one shuffle of partial counts."""
    text = [c for c in S.string_columns(df.schema) if c not in UNCOUNTED_TEXT]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in text]
    )
    return (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("records"))
    )

"""Value segments and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuegrain.functions.scoring import recommended_cac, value_segment
from valuegrain.operators.customers import segment_column, value_column
from valuegrain.schema import SEGMENTS
from valuegrain.session import constant_table

ALL = "All"


def score_columns(value: Column) -> dict[str, Column]:
    """Rounded value, its segment and the recommended acquisition cost."""
    rounded = F.round(value, 2)
    return {
        "predicted_clv": rounded,
        "predicted_segment": value_segment(rounded),
        "recommended_cac": recommended_cac(rounded),
    }


def segment_rows(df: DataFrame, segment: str) -> DataFrame:
    """Customers of one segment."""
    if segment not in SEGMENTS:
        raise ValueError(f"unknown segment: {segment}")
    return df.where(F.col(_segment(df)) == segment)


def _segment(df: DataFrame) -> str:
    name = segment_column(df)
    if name is None:
        raise ValueError("no segment column found")
    return name


def every_segment(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach ``totals`` to all three segment names, present or not. Three rows."""
    names = constant_table(df.sparkSession, [(name,) for name in SEGMENTS], "segment")
    return F.broadcast(names).join(totals, "segment", "left")


def segment_summary(df: DataFrame) -> DataFrame:
    """Count, share, mean and total value and mean cost of each segment.

    Means are null for a segment without customers.
    """
    grouped = df.groupBy(F.col(_segment(df)).alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("predicted_clv").alias("avg_predicted_clv"),
        F.sum("predicted_clv").alias("total_predicted_value"),
        F.avg("recommended_cac").alias("avg_recommended_cac"),
    )
    # One row per segment label, so the total over all of them is tiny.
    everyone = F.sum("customers").over(Window.partitionBy())
    full = every_segment(df, grouped.withColumn("everyone", everyone))
    count = F.coalesce(F.col("customers"), F.lit(0))
    return full.select(
        "segment",
        count.alias("customers"),
        F.coalesce(F.try_divide(count * 100.0, F.col("everyone")), F.lit(0.0)).alias("percentage"),
        "avg_predicted_clv",
        F.coalesce("total_predicted_value", F.lit(0.0)).alias("total_predicted_value"),
        "avg_recommended_cac",
    )


def segment_analysis(df: DataFrame) -> DataFrame:
    """Count, share, mean and total value and mean cost of each segment and of all rows.

    All three segments have a row; means are null for one without customers.
    """
    label = _segment(df)
    value = value_column(df)
    cost = F.col("recommended_cac") if "recommended_cac" in df.columns else F.lit(None)
    rolled = df.rollup(label).agg(
        F.grouping(label).alias("is_total"),
        F.count(F.lit(1)).alias("customers"),
        F.avg(value).alias("avg_predicted_clv"),
        F.sum(value).alias("total_predicted_value"),
        F.avg(cost.cast("double")).alias("avg_recommended_cac"),
    )
    # One row per segment label and one for all of them.
    named = rolled.withColumns(
        {
            "segment": F.when(F.col("is_total") == 1, ALL).otherwise(F.col(label)),
            "everyone": F.max("customers").over(Window.partitionBy()),
        }
    )
    names = constant_table(df.sparkSession, [(n,) for n in (*SEGMENTS, ALL)], "segment")
    full = F.broadcast(names).join(named, "segment", "left")
    count = F.coalesce(F.col("customers"), F.lit(0))
    return full.select(
        "segment",
        count.alias("customers"),
        F.coalesce(F.try_divide(count * 100.0, F.col("everyone")), F.lit(0.0)).alias("percentage"),
        "avg_predicted_clv",
        F.coalesce("total_predicted_value", F.lit(0.0)).alias("total_predicted_value"),
        "avg_recommended_cac",
    )

"""Regression and segment metrics of predictions against known values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.functions.scoring import value_segment

R2_GATE = 0.5


def _metric_columns(truth: Column, guess: Column) -> dict[str, Column]:
    """Aggregates of one pass. R2 uses centred moments, which stay accurate for
    large values, and is null for a constant truth."""
    error = guess - truth
    spread = F.var_pop(truth) * F.count(truth)
    relative = F.when(truth != 0, F.abs(F.try_divide(error, truth)))
    return {
        "rows": F.count(error),
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "r2": 1 - F.try_divide(F.sum(error * error), spread),
        "mape": F.avg(relative) * 100,
    }


def regression_metrics(
    df: DataFrame, truth: str = "actual_clv", guess: str = "predicted_clv"
) -> DataFrame:
    """One row: rows, MAE, RMSE, R2 and MAPE over non-zero truths, unrounded."""
    columns = _metric_columns(F.col(truth), F.col(guess))
    return df.agg(*[c.alias(name) for name, c in columns.items()])


def rounded_metrics(metrics: DataFrame) -> DataFrame:
    digits = {"mae": 2, "rmse": 2, "r2": 4, "mape": 2}
    return metrics.withColumns({c: F.round(c, n) for c, n in digits.items()})


def member_metrics(df: DataFrame, truth: str, guesses: dict[str, str]) -> DataFrame:
    """The metrics of several prediction columns from one scan, one row each."""
    aggregates, entries = [], []
    for model, guess in guesses.items():
        columns = _metric_columns(F.col(truth), F.col(guess))
        aggregates.append(F.struct(*[c.alias(n) for n, c in columns.items()]).alias(model))
        fields = [F.col(f"{model}.{n}").alias(n) for n in columns]
        entries.append(F.struct(F.lit(model).alias("model"), *fields))
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def with_quality_gate(metrics: DataFrame, minimum: float = R2_GATE) -> DataFrame:
    return metrics.withColumn("passed", F.coalesce(F.col("r2") >= minimum, F.lit(False)))


def segment_accuracy(df: DataFrame, truth: str = "actual_clv", guess: str = "predicted_clv"):
    hit = value_segment(F.col(truth)) == value_segment(F.col(guess))
    return df.agg(F.avg(hit.cast("int")).alias("segment_accuracy"))


def segment_errors(df: DataFrame, truth: str = "actual_clv", guess: str = "predicted_clv"):
    """RMSE and row count by the segment of the true value."""
    error = F.col(guess) - F.col(truth)
    return df.groupBy(value_segment(F.col(truth)).alias("segment")).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("customers")
    )

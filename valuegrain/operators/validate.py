"""Row contract: rules, violations and the valid/quarantine split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain import schema as S


def contract_rules(columns: list[str]) -> dict[str, Column]:
    """Rule name to the condition under which a row breaks it.

    Columns without a default are required; a column with a default may be null.
    """
    rules: dict[str, Column] = {}
    if S.ID in columns:
        row_id = F.trim(S.ID)
        rules["customer_id:required"] = F.col(S.ID).isNull()
        length = F.length(row_id)
        rules["customer_id:length"] = (length < 1) | (length > S.ID_MAX_LENGTH)
        rules["customer_id:pattern"] = ~row_id.rlike(S.ID_PATTERN)
    for name, limit in S.LIMITS.items():
        if name not in columns:
            continue
        value = F.col(name)
        if limit.default is None:
            rules[f"{name}:required"] = value.isNull()
        rules[f"{name}:range"] = (value < limit.low) | (value > limit.high) | F.isnan(
            value.cast("double")
        )
    for name in S.CONTRACT_DEFAULTS:
        if name in columns:
            rules[f"{name}:value"] = ~F.col(name).isin(*S.VOCABULARIES[name])
    if {"days_since_first_purchase", "days_since_last_purchase"} <= set(columns):
        rules["days:order"] = F.col("days_since_last_purchase") > F.col(
            "days_since_first_purchase"
        )
    return rules


def apply_contract(df: DataFrame) -> DataFrame:
    """Fill contract defaults and derive the order value where it is zero."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(limit.default).cast(df.schema[name].dataType))
        for name, limit in S.LIMITS.items()
        if limit.default is not None and name in df.columns
    }
    for name, default in S.CONTRACT_DEFAULTS.items():
        if name in df.columns:
            filled[name] = F.coalesce(F.col(name), F.lit(default))
    df = df.withColumns(filled) if filled else df
    if {"avg_order_value", "total_spent", "total_orders"} <= set(df.columns):
        df = df.withColumn("avg_order_value", derived_order_value())
    return df


def derived_order_value() -> Column:
    aov, orders = F.col("avg_order_value"), F.col("total_orders")
    return F.when(
        (aov == 0) & (orders > 0), F.try_divide(F.col("total_spent"), orders)
    ).otherwise(aov)


def with_violations(df: DataFrame) -> DataFrame:
    """Add ``violations``, the names of the broken rules of each row."""
    names = [F.when(broken, F.lit(rule)) for rule, broken in contract_rules(df.columns).items()]
    return df.withColumn("violations", F.array_compact(F.array(*names)))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def quarantined_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)


def violation_rows(checked: DataFrame) -> DataFrame:
    """One row per customer and broken rule."""
    return checked.select(S.ID, F.explode("violations").alias("rule"))

"""Readers and writers of customer, feature and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.schema import CUSTOMER_SCHEMA


def read_customers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Customer CSV with a header, types declared, dates parsed, categories decoded.

    Quotes inside a field are doubled. The text "None" stays a campaign name; only an empty field is null. Columns the
    file lacks are left out, so dependent features are skipped.
    """
    header = spark.read.option("header", True).csv(path).columns
    declared = {f.name: f for f in CUSTOMER_SCHEMA}
    as_text = T.StructType(
        [
            declared[name]
            if name in declared and not _decoded(declared[name])
            else T.StructField(name, T.StringType())
            for name in header
        ]
    )
    raw = (
        spark.read.schema(as_text)
        .option("header", True)
        .option("nullValue", "")
        .option("escape", '"')
        .csv(path)
    )
    decoded = {
        name: decode_categories(name) if name == "product_categories" else F.to_date(name)
        for name in header
        if name in declared and _decoded(declared[name])
    }
    return raw.withColumns(decoded) if decoded else raw


def _decoded(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.ArrayType, T.DateType))


def decode_categories(column: str):
    """JSON list text to an array of names."""
    return F.from_json(F.col(column), "array<string>")


def category_count(column: str):
    return F.when(F.col(column).isNotNull(), F.size(column))


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_features_csv(df: DataFrame, path: str) -> None:
    """Feature table as CSV; list columns become JSON text."""
    lists = {
        f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, T.ArrayType)
    }
    flat = df.withColumns(lists) if lists else df
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Metrics or importance table as JSON lines."""
    df.write.mode("overwrite").json(path)

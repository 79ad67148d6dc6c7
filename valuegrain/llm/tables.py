"""Reading the input tables and cutting lineage with tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.session import shared_dir


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that later steps read more than once, and read it back.

    The copy lies under ``spark.checkpoint.dir``, so a lost executor costs the tasks that it
    ran, not the steps before them.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the frame has."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row, however often it is used."""
    return F.transform(F.array(value), body)[0]

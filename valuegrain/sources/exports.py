"""Audience export for the advertising platform."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain.operators.customers import segment_column
from valuegrain.schema import SEGMENTS

DEFAULT_FIELDS = ("customer_id", "acquisition_source", "predicted_clv")


def audience_export(
    df: DataFrame,
    segment: str | None = None,
    fields: tuple[str, ...] | list[str] = DEFAULT_FIELDS,
    export_date: datetime.date | None = None,
) -> DataFrame:
    """Requested fields that exist, with the export date and the segment name.

    Without ``segment`` all audiences are exported in one pass.
    """
    if segment is not None and segment not in SEGMENTS:
        raise ValueError(f"unknown segment: {segment}")
    label = F.col(segment_column(df))
    wanted = label == segment if segment else label.isin(*SEGMENTS)
    day = (export_date or datetime.date.today()).isoformat()
    kept = [F.col(f) for f in fields if f in df.columns]
    return df.where(wanted).select(
        *kept, F.lit(day).alias("export_date"), label.alias("segment")
    )


def write_audiences(export: DataFrame, path: str) -> None:
    """CSV files in one folder per segment."""
    export.write.mode("overwrite").option("header", True).partitionBy("segment").csv(path)

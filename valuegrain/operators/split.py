"""Train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.operators.order_stats import SAMPLE_ROWS, order_statistics
from valuegrain.schema import ID

LAST_DAY = 2**31 - 1
PARTS = ("train", "validation", "test")


def temporal_split(
    df: DataFrame,
    *,
    percents: tuple[int, int, int] = (70, 15, 15),
    date_column: str = "first_purchase_date",
    output: str = "split",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Label rows by their place in the (date, id) order; missing dates come last.

    The two cut keys are found exactly by selection, so no row is sorted or moved.
    """
    if abs(sum(percents) - 100) > 1:
        raise ValueError(f"percents must sum to 100, got {sum(percents)}")
    day = F.coalesce(F.unix_date(date_column), F.lit(LAST_DAY))
    keyed = df.select(F.col(ID), day.alias("day"))
    rows = keyed.count()
    ends = [rows * percents[0] // 100, rows * (percents[0] + percents[1]) // 100]
    ranks = {end - 1 for end in ends if end > 0}
    keys = order_statistics(
        keyed, {"day": ranks}, {"day": rows}, sample_rows=sample_rows
    )["day"]
    label: Column = F.lit(PARTS[2])
    for part, end in reversed(list(zip(PARTS, ends))):
        if end > 0:
            last_day, last_id = keys[end - 1]
            reached = (day < last_day) | ((day == last_day) & (F.col(ID) <= last_id))
            label = F.when(reached, part).otherwise(label)
    return df.withColumn(output, label)


def random_part(seed: int, *, id_column: str = ID) -> Column:
    """Stable pseudo-random percentile of a row, from its id and the seed alone.

    The first eight hex digits of an MD5 sum, so that any SQL engine finds the same rows.
    """
    digest = F.md5(F.concat_ws(":", F.col(id_column), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def random_split(df: DataFrame, *, test_percent: int = 20, seed: int = 42, output: str = "split"):
    """Label ``test_percent`` of the rows "test"; unchanged by repartitioning."""
    held_out = random_part(seed) < test_percent
    return df.withColumn(output, F.when(held_out, PARTS[2]).otherwise(PARTS[0]))

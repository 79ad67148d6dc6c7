"""Percentile ranks of every row without a single-task window."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valuegrain.schema import ID

#: Rows of a ranking bucket, and of a salt of a repeated value, about.
BUCKET_ROWS, SALT_ROWS = 100_000, 100_000


def average_percent_rank(
    df: DataFrame,
    column: str,
    output: str,
    *,
    size: int,
    edges: Sequence[float],
    id_column: str = ID,
) -> DataFrame:
    """Add the average rank of ``column`` divided by ``size``, exactly."""
    return average_percent_ranks(df, {column: output}, sizes={column: size}, edges={column: edges}, id_column=id_column)


def average_percent_ranks(
    df: DataFrame,
    outputs: dict[str, str],
    *,
    sizes: dict[str, int],
    edges: dict[str, Sequence[float]],
    id_column: str = ID,
) -> DataFrame:
    """Add the average rank of each column of ``outputs`` divided by its size, exactly.

    The columns are ranked together, as narrow rows of (column, value); the table itself is
    joined once. Rows are first counted per value, so a value shared by many rows is one row of
    the ranking. Values are ranked in buckets between ``edges``, cut finer for large tables: a
    bucket depends on the value alone, so edges decide how even the work is and never the result.
    Values that repeat among the edges hold at least about one step of all rows; in the join back
    they are salted by as many salts as the number of rows asks for.
    """
    columns = list(outputs)
    row = F.struct(id_column, *columns)
    entries = [
        F.struct(F.lit(i).alias("of"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)
    ]
    narrow = df.select(row.alias("ranked_row"), F.inline(F.array(*entries))).where("value IS NOT NULL")
    counts = _bucketed(narrow.groupBy("of", "value").agg(F.count(F.lit(1)).alias("ties")), columns, sizes, edges)
    # One row for each bucket, whose number follows from the number of rows.
    place = ["bucket", "part"]
    ahead = Window.partitionBy("of").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.groupBy("of", *place)
        .agg(F.sum("ties").alias("held"))
        .select("of", *place, F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("offset"))
    )
    before = Window.partitionBy("of", *place).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("below", F.coalesce(F.sum("ties").over(before), F.lit(0)))
    total = F.get(F.array(*[F.lit(sizes[c]) for c in columns]), F.col("of"))
    share = (F.col("offset") + F.col("below") + (F.col("ties") + 1) / 2) / total
    ranked = ranked.join(offsets, ["of", *place]).select("of", "value", share.alias("share"))

    hot = F.lit(False)
    for i, c in enumerate(columns):
        heavy = sorted({float(a) for a, b in zip(edges[c], edges[c][1:]) if a == b})
        if heavy:
            hot = hot | ((F.col("of") == i) & F.col("value").isin(heavy))
    salts = max(1, -(-max(sizes.values()) // SALT_ROWS))
    spread = F.sequence(F.lit(0), F.lit(salts - 1))
    ranked = ranked.withColumn("salt", F.explode(F.when(hot, spread).otherwise(F.array(F.lit(0)))))
    salt = F.pmod(F.xxhash64("ranked_row"), F.lit(salts)).cast("int")
    met = narrow.withColumn("salt", F.when(hot, salt).otherwise(F.lit(0))).join(ranked, ["of", "value", "salt"])
    shares = [F.max(F.when(F.col("of") == i, F.col("share"))).alias(outputs[c]) for i, c in enumerate(columns)]
    wide = met.groupBy("ranked_row").agg(*shares)
    return df.withColumn("ranked_row", row).join(wide, "ranked_row", "left").drop("ranked_row")


def _bucketed(
    counts: DataFrame, columns: list[str], sizes: dict[str, int], edges: dict[str, Sequence[float]]
) -> DataFrame:
    """Add bucket, by the edges of a row's column, and part, by how far the value lies in it."""
    limits = [[float("-inf"), *(sorted(set(map(float, edges[c]))) or [0.0]), float("inf")] for c in columns]
    own = {f"value_{i}": F.when(F.col("of") == i, F.col("value")) for i in range(len(columns))}
    found = Bucketizer(
        splitsArray=limits,
        inputCols=list(own),
        outputCols=[f"bucket_{i}" for i in range(len(columns))],
        handleInvalid="keep",
    ).transform(counts.withColumns(own))
    chosen = F.lit(None).cast("double")
    for i in range(len(columns)):
        chosen = F.when(F.col("of") == i, F.col(f"bucket_{i}")).otherwise(chosen)
    found = found.withColumn("bucket", chosen.cast("int"))
    parts = max(-(-sizes[c] // (BUCKET_ROWS * len(limit))) for c, limit in zip(columns, limits))
    part = F.lit(0)
    if parts > 1:
        ends = F.get(F.array(*[F.array(*map(F.lit, limit)) for limit in limits]), F.col("of"))
        low, high = F.get(ends, F.col("bucket")), F.get(ends, F.col("bucket") + 1)
        within = F.floor((F.col("value") - low) / (high - low) * parts)
        inner = (low > float("-inf")) & (high < float("inf"))
        part = F.when(inner, F.greatest(F.lit(0), F.least(within, F.lit(parts - 1)))).otherwise(0)
    return found.select("of", "value", "ties", "bucket", part.cast("int").alias("part"))


def fitted_percent_rank(
    df: DataFrame, column: str, output: str, *, edges: Sequence[float]
) -> DataFrame:
    """Percentile of new rows against fitted, evenly spaced quantile edges.

    Stateless and good to about one step; for rows that were not part of the fit.
    """
    steps = len(edges) + 1
    distinct = sorted(set(edges))
    ordered = sorted(edges)
    shares = [0.5 / steps]
    for edge in distinct:
        held = bisect_left(ordered, edge) + bisect_right(ordered, edge) + 1
        shares.append(min(held / (2 * steps), 1.0))
    value, place = f"{column}:double", f"{column}:bucket"
    located = Bucketizer(
        splits=[float("-inf"), *distinct, float("inf")],
        inputCol=value,
        outputCol=place,
        handleInvalid="keep",
    ).transform(df.withColumn(value, F.col(column).cast("double")))
    table = F.array(*[F.lit(s) for s in shares])
    return located.withColumn(output, F.get(table, F.col(place).cast("int"))).drop(value, place)

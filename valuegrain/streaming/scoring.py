"""Score and validate customer rows as they arrive. Both are stateless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from valuegrain.operators.validate import quarantined_rows, valid_rows, with_violations
from valuegrain.plans.model_store import ModelStore
from valuegrain.schema import CUSTOMER_SCHEMA
from valuegrain.session import keep


def customer_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = CUSTOMER_SCHEMA,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Customer rows of parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write_stream(
    rows: DataFrame, path: str, checkpoint: str, *, continuous: bool = False
) -> StreamingQuery:
    """Append to parquet files; each input row is written once, also after a restart."""
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def score_stream(
    rows: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    **options,
) -> StreamingQuery:
    """Score rows with a fitted model's ``score`` and append them to ``path``."""
    return write_stream(score(rows), path, checkpoint, **options)


def score_stream_by_store(
    rows: DataFrame, store: ModelStore, path: str, checkpoint: str, *, continuous: bool = False
) -> StreamingQuery:
    """Score each batch with the version that is current when it begins.

    The output has the version as ``model_version``. A batch's files lie in a folder of its
    number, which a repeated batch replaces. A version is loaded once, not for each batch.
    """
    loaded: dict = {}

    def score(batch: DataFrame, number: int) -> None:
        version = store.current()
        if version not in loaded:
            loaded.clear()
            loaded[version] = store.load(version)
        scored = loaded[version].score(batch).withColumn("model_version", F.lit(version))
        scored.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def route_stream(
    rows: DataFrame,
    valid_path: str,
    quarantine_path: str,
    checkpoint: str,
    *,
    continuous: bool = False,
) -> StreamingQuery:
    """Valid rows to one sink, rows that break the contract to another.

    Each batch is read and checked once and split afterwards. Its files lie in a folder of the
    batch's number in both sinks, which a repeated batch replaces.
    """

    def route(batch: DataFrame, number: int) -> None:
        checked = keep(with_violations(batch))
        for part, path in ((valid_rows, valid_path), (quarantined_rows, quarantine_path)):
            part(checked).write.mode("overwrite").parquet(f"{path}/batch={number}")
        checked.unpersist()

    writer = rows.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()

"""Session defaults for local runs and the shared scratch folder of a session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def prepare_session(spark: SparkSession) -> SparkSession:
    """Fit code generation to wide projections.

    The JVM never compiles a method above 8000 bytes of bytecode. A fused stage with a
    hundred feature columns exceeds that and would run interpreted; with this limit
    Spark splits such a stage into small methods, which is 4 to 8 times faster.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def local_session(
    app: str = "valuegrain", cores: int | str = "*", shared: str | None = None
) -> SparkSession:
    """Small local session for tests and the benchmark; a cluster brings its own.

    Call-site capture of the Python API is off: it makes every column expression many
    times slower to build and wide feature tables have hundreds of them. Clusters are
    well advised to set the same option. ``shared`` becomes ``spark.checkpoint.dir``.
    """
    parallelism = "8" if cores == "*" else str(cores)
    builder = SparkSession.builder
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    session = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return prepare_session(session)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the session's ``spark.checkpoint.dir``.

    The setting names storage every executor can reach. Where it is unset, as in tests, the
    folder lies in the session's warehouse, which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Cache a frame that several passes read. Lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def constant_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table of literals built inside the JVM, without Python workers."""
    names = columns.split()
    entries = [
        F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row)]) for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*entries)))

"""Population statistics of a customer table, fitted once and reused for scoring."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.operators.order_stats import (
    SAMPLE_ROWS,
    interpolate,
    order_statistics,
    quantile_ranks,
)
from valuegrain.session import constant_table

SCORED_COLUMNS = ("days_since_last_purchase", "total_orders", "total_spent")
STATISTICAL_COLUMNS = ("total_spent", "total_orders", "avg_order_value")
QUANTILE_SHARES = {"avg_order_value": (0.5, 0.75, 0.9), "total_spent": (0.5,)}
EDGE_STEPS = 200


@dataclass
class Profile:
    """Driver-side scalars only; their number does not depend on the data."""

    rows: int = 0
    bins: int = 5
    sizes: dict[str, int] = field(default_factory=dict)
    maxima: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    quantiles: dict[str, dict[str, float]] = field(default_factory=dict)
    cuts: dict[str, list[list]] = field(default_factory=dict)
    edges: dict[str, list[float]] = field(default_factory=dict)
    spans: dict[str, list[float]] = field(default_factory=dict)

    def quantile(self, column: str, share: float) -> float | None:
        return self.quantiles.get(column, {}).get(str(share))

    def median(self, column: str) -> float | None:
        return self.quantile(column, 0.5)

    def save(self, spark: SparkSession, path: str) -> None:
        row = constant_table(spark, [(json.dumps(asdict(self)),)], "profile")
        row.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Profile:
        return Profile(**json.loads(spark.read.parquet(path).first()["profile"]))


def cut_ranks(size: int, bins: int) -> list[int]:
    """Last zero-based rank of each quantile bin but the top one."""
    return [b * (size - 1) // bins for b in range(1, bins)]


def fit_profile(
    df: DataFrame,
    *,
    bins: int = 5,
    sample_rows: int = SAMPLE_ROWS,
    edge_steps: int = EDGE_STEPS,
) -> Profile:
    """Two scans: moments and sketch edges, then the exact order statistics."""
    watched = [
        c for c in dict.fromkeys(SCORED_COLUMNS + STATISTICAL_COLUMNS) if c in df.columns
    ]
    steps = [i / edge_steps for i in range(1, edge_steps)]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for c in watched:
        aggregates += [
            F.count(c).alias(f"{c}:size"),
            F.max(c).alias(f"{c}:max"),
            F.avg(c).alias(f"{c}:mean"),
            F.stddev_samp(c).alias(f"{c}:sd"),
        ]
        if c in STATISTICAL_COLUMNS:
            aggregates.append(F.percentile_approx(c, steps, 10_000).alias(f"{c}:edges"))
    row = df.agg(*aggregates).first()
    profile = Profile(rows=row["rows"], bins=bins)
    for c in watched:
        profile.sizes[c] = row[f"{c}:size"]
        profile.maxima[c] = row[f"{c}:max"]
        profile.means[c] = row[f"{c}:mean"]
        profile.deviations[c] = row[f"{c}:sd"]
        if c in STATISTICAL_COLUMNS:
            profile.edges[c] = [float(e) for e in row[f"{c}:edges"] or []]

    ranks: dict[str, set[int]] = {}
    for c in watched:
        size = profile.sizes[c]
        if size == 0:
            continue
        wanted = ranks.setdefault(c, set())
        if c in SCORED_COLUMNS and profile.rows >= bins:
            wanted.update(cut_ranks(size, bins))
        for share in QUANTILE_SHARES.get(c, ()):
            wanted.update(quantile_ranks(share, size)[:2])
    keys = order_statistics(df, ranks, profile.sizes, sample_rows=sample_rows) if ranks else {}
    for c in ranks:
        size = profile.sizes[c]
        if c in SCORED_COLUMNS and profile.rows >= bins:
            profile.cuts[c] = [list(keys[c][r]) for r in cut_ranks(size, bins)]
        shares = QUANTILE_SHARES.get(c, ())
        profile.quantiles[c] = {str(s): interpolate(keys[c], s, size) for s in shares}
    return profile

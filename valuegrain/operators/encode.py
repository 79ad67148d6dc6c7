"""Feature selection, alignment, one-hot encoding and robust scaling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain import schema as S
from valuegrain.operators.order_stats import value_quantiles

QUARTILES = [0.25, 0.5, 0.75]
LABEL_TEXT = ("rfm_string", "rfm_segment")


def training_columns(df: DataFrame, target: str = "actual_clv") -> DataFrame:
    """Drop id, dates, category list, segment label and target."""
    return df.drop(*S.NON_FEATURES, target)


def numeric_features(df: DataFrame, exclude: tuple[str, ...] = ("tenure_bucket",)) -> list[str]:
    """Numeric columns fit for a model."""
    barred = {*S.NON_FEATURES, *LABEL_TEXT, *exclude}
    return [c for c in S.numeric_columns(df.schema) if c not in barred]


def script_features(df: DataFrame, target: str = "actual_clv") -> list[str]:
    """Numeric columns as the batch jobs choose them, the tenure bucket included."""
    return numeric_features(df, exclude=(target,))


def align(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly ``columns`` in their order; missing ones are zero, others are dropped."""
    present = set(df.columns)
    chosen = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
        if c in present
        else F.lit(0.0).alias(c)
        for c in columns
    ]
    return df.select(*keep, *chosen)


@dataclass
class Encoder:
    """Numeric columns, one-hot levels and robust scales, fixed at fit time."""

    numeric: list[str]
    levels: dict[str, list[str]] = field(default_factory=dict)
    centers: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        dummies = [f"{c}_{v}" for c, values in self.levels.items() for v in values[1:]]
        return self.numeric + dummies

    def columns(self, available: list[str]) -> list[str]:
        """One unscaled SQL expression per feature, zero where its input is missing.

        The first level of a text column is the base; an unseen level counts as it.
        Hundreds of expressions build faster from text than from column objects.
        """
        present = set(available)
        chosen = []
        for c in self.numeric:
            chosen.append(f"coalesce(cast(`{c}` as double), 0D)" if c in present else "0D")
        for c, values in self.levels.items():
            for value in values[1:]:
                hit = f"CASE WHEN `{c}` = {_literal(value)} THEN 1D ELSE 0D END"
                chosen.append(hit if c in present else "0D")
        return chosen

    def encode(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        named = zip(self.columns(df.columns), self.features)
        return df.selectExpr(*keep, *[f"{sql} AS `{name}`" for sql, name in named])

    def vectors(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """``keep`` columns and the scaled ``features`` vector."""
        scaled = [
            f"({sql} - {self.centers[name]!r}D) / {self.scales[name]!r}D AS f{i}"
            for i, (sql, name) in enumerate(zip(self.columns(df.columns), self.features))
        ]
        inputs = [f"f{i}" for i in range(len(scaled))]
        assembler = VectorAssembler(inputCols=inputs, outputCol="features")
        return assembler.transform(df.selectExpr(*keep, *scaled)).select(*keep, "features")


def _literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def fit_encoder(
    df: DataFrame,
    *,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
) -> Encoder:
    """Level counts of the text columns, exact interpolated quartiles of the numeric ones.

    Quartiles of a 0/1 level column follow from its count. A missing number counts as zero,
    as it does in the encoded column. A quartile range of zero scales by one, so a rare flag
    keeps its meaning. The levels are part of the model, hence as many as the features.
    """
    numeric = numeric_features(df) if numeric is None else numeric
    if categorical is None:
        categorical = [c for c in S.string_columns(df.schema) if c not in S.NON_FEATURES]
    counts = _level_counts(df, categorical)
    encoder = Encoder(numeric, {c: sorted(found) for c, found in counts.items()})
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric])
    rows = df.count()
    exact = value_quantiles(filled, dict.fromkeys(numeric, QUARTILES), dict.fromkeys(numeric, rows))
    quartiles = {c: [exact[c][q] for q in QUARTILES] for c in numeric}
    for c, values in encoder.levels.items():
        for value in values[1:]:
            zeros = rows - counts[c][value]
            quartiles[f"{c}_{value}"] = [float(q * rows > zeros) for q in QUARTILES]
    for name, (low, middle, high) in quartiles.items():
        encoder.centers[name] = float(middle)
        encoder.scales[name] = float(high - low) or 1.0
    return encoder


def _level_counts(df: DataFrame, columns: list[str]) -> dict[str, dict[str, int]]:
    """Rows per level of each text column."""
    if not columns:
        return {}
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).alias("level")) for c in columns]
    )
    counted = (
        df.select(F.inline(pairs)).where(F.col("level").isNotNull()).groupBy("name", "level")
    ).count()
    levels: dict[str, dict[str, int]] = {c: {} for c in columns}
    for row in counted.collect():
        levels[row["name"]][row["level"]] = row["count"]
    return levels

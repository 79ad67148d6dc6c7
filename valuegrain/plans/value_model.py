"""The customer value model: clean, derive features, encode, predict, segment."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.functions.scoring import interval_columns, prediction_confidence
from valuegrain.operators.clean import Cleaning, fit_cleaning, require_rows
from valuegrain.operators.encode import Encoder, fit_encoder, script_features
from valuegrain.operators.ensemble import (
    HELD_OUT,
    KEY,
    LABEL,
    Ensemble,
    EnsembleConfig,
    fit_ensemble,
)
from valuegrain.operators.evaluate import (
    member_metrics,
    regression_metrics,
    segment_accuracy,
    segment_errors,
    with_quality_gate,
)
from valuegrain.operators.profile import Profile
from valuegrain.operators.segments import score_columns
from valuegrain.operators.split import PARTS, random_split, temporal_split
from valuegrain.plans.features import FAMILIES, FeaturePlan, fit_features
from valuegrain.schema import ID
from valuegrain.session import constant_table, keep, shared_dir

TARGET = "actual_clv"
ORIGIN = "origin"
TRAIN, VALIDATION, TEST = PARTS
MIN_ROWS = 100
ROWS_PER_PARTITION = 50_000
TOP_FEATURES = 15


@dataclass
class ValueModel:
    """Everything scoring needs. Scoring is a row-wise plan without a shuffle, so the
    same call serves a batch table and a stream."""

    cleaning: Cleaning
    plan: FeaturePlan
    encoder: Encoder
    ensemble: Ensemble

    def predict(self, df: DataFrame) -> DataFrame:
        """Input columns, member predictions and the unrounded ensemble value."""
        carried = df.select("*", F.struct("*").alias(ORIGIN))
        features = self.plan.transform(self.cleaning.apply(carried), FAMILIES)
        vectors = self.encoder.vectors(features, keep=(ORIGIN,))
        predicted = self.ensemble.predict(vectors)
        members = list(self.ensemble.guesses.values())
        return predicted.select(f"{ORIGIN}.*", *members, "ensemble")

    def score(self, df: DataFrame) -> DataFrame:
        """Input columns plus value, segment and recommended acquisition cost."""
        predicted = self.predict(df)
        scored = predicted.withColumns(score_columns(F.col("ensemble")))
        return scored.drop("ensemble", *self.ensemble.guesses.values())

    def score_with_interval(self, df: DataFrame, confidence: float = 0.95) -> DataFrame:
        """Scores with confidence and the interval from the members' disagreement."""
        predicted = self.predict(df).withColumns(score_columns(F.col("ensemble")))
        members = [F.col(c) for c in self.ensemble.guesses.values()]
        value = F.col("predicted_clv")
        extra = {"confidence": prediction_confidence(value)}
        extra.update(interval_columns(value, members, confidence))
        return predicted.withColumns(extra).drop("ensemble", *self.ensemble.guesses.values())

    def save(self, spark: SparkSession, path: str) -> None:
        self.ensemble.save(spark, f"{path}/ensemble")
        self.plan.profile.save(spark, f"{path}/profile")
        state = {
            "cleaning": asdict(self.cleaning),
            "encoder": asdict(self.encoder),
            "method": self.plan.method,
        }
        frame = constant_table(spark, [(json.dumps(state),)], "state")
        frame.write.mode("overwrite").parquet(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ValueModel:
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        profile = Profile.load(spark, f"{path}/profile")
        return ValueModel(
            Cleaning(**state["cleaning"]),
            FeaturePlan(profile, state["method"]),
            Encoder(**state["encoder"]),
            Ensemble.load(spark, f"{path}/ensemble"),
        )


@dataclass
class Training:
    """A fitted model with the labelled rows it was fitted and judged on."""

    model: ValueModel
    rows: DataFrame

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name).drop("split")

    def scored(self, part: str = TEST) -> DataFrame:
        return self.model.score(self.part(part))

    def metrics(self, part: str = TEST) -> DataFrame:
        """One row per member and one for the ensemble, all on the same rows."""
        guesses = {**self.model.ensemble.guesses, "ensemble": "ensemble"}
        return member_metrics(self.model.predict(self.part(part)), TARGET, guesses)

    def importance(self, count: int | None = TOP_FEATURES) -> DataFrame:
        table = self.model.ensemble.importance(self.rows.sparkSession)
        return table.where(F.col("rank") <= count) if count else table


def train_value_model(
    df: DataFrame,
    config: EnsembleConfig | None = None,
    *,
    split: str = "random",
    percents: tuple[int, int, int] = (70, 15, 15),
    categorical: list[str] | None = None,
    min_rows: int = MIN_ROWS,
) -> Training:
    """Fit a value model on a labelled customer table.

    ``split="random"`` holds out a fifth for the test and a fifth of the rest for
    validation by id hash; ``"temporal"`` cuts by first purchase date. Population
    statistics, cleaning limits, levels and scales come from the training part only.
    """
    config = config or EnsembleConfig()
    require_rows(df, min_rows)
    if split == "temporal":
        labelled = temporal_split(df, percents=percents)
    elif split == "random":
        labelled = random_split(df, seed=config.seed)
        inner = random_split(labelled, seed=config.seed + 1, output="inner")
        held = (F.col("split") == TRAIN) & (F.col("inner") == TEST)
        labelled = inner.withColumn(
            "split", F.when(held, VALIDATION).otherwise(F.col("split"))
        ).drop("inner")
    else:
        raise ValueError(f"unknown split: {split}")
    rows = keep(labelled)

    train = rows.where(F.col("split") == TRAIN).drop("split")
    cleaning = fit_cleaning(train)
    cleaned = keep(cleaning.apply(rows))
    plan = fit_features(cleaned.where(F.col("split") == TRAIN))
    # Read by the encoder twice and by the vectors, and the start of lean plans.
    features = keep(plan.transform(cleaned, FAMILIES))
    known = features.where(F.col("split") == TRAIN)
    numeric = [c for c in script_features(features) if c != TARGET]
    text = categorical
    if text is None:
        text = [
            c
            for c in ("acquisition_source", "campaign_type", "rfm_string", "rfm_segment")
            if c in features.columns
        ]
    encoder = fit_encoder(known, numeric=numeric, categorical=text)
    fitting = features.where(F.col("split") != TEST).withColumns(
        {
            LABEL: F.col(TARGET),
            HELD_OUT: F.col("split") == VALIDATION,
            KEY: F.xxhash64(ID),
        }
    )
    # Tree learners run several jobs per level, so partitions should not be tiny.
    wanted = math.ceil(plan.profile.rows / ROWS_PER_PARTITION)
    partitions = max(wanted, df.sparkSession.sparkContext.defaultParallelism)
    vectors = encoder.vectors(fitting, keep=(LABEL, HELD_OUT, KEY)).coalesce(partitions)
    # Read by hundreds of jobs, so it is stored: their plans then begin here.
    stored = shared_dir(df.sparkSession, "vectors")
    vectors.write.parquet(stored)
    vectors = keep(df.sparkSession.read.parquet(stored))
    ensemble = fit_ensemble(vectors, encoder.features, config)
    for frame in (vectors, features, cleaned):
        frame.unpersist()
    return Training(ValueModel(cleaning, plan, encoder, ensemble), rows)


def evaluate_value_model(model: ValueModel, labelled: DataFrame) -> dict[str, DataFrame]:
    """The evaluation job's tables: metrics with the gate, accuracy, segment errors."""
    scored = keep(model.predict(labelled).withColumn("predicted_clv", F.col("ensemble")))
    return {
        "metrics": with_quality_gate(regression_metrics(scored)),
        "segment_accuracy": segment_accuracy(scored),
        "segment_errors": segment_errors(scored),
    }

"""Weighted ensemble of boosted trees, a forest and ridge regression."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.regression import (
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressionModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.operators.forest import ForestModel, ForestSettings, fit_forest, forest_edges
from valuegrain.operators.trees import TreeModel, TreeSettings, fit_trees, quantile_edges
from valuegrain.session import constant_table

MAE_FLOOR = 1e-6
LABEL, HELD_OUT, KEY = "label", "held_out", "key"
LINEAR, FOREST = "ridge", "random_forest"
MODEL_CLASSES = {
    "boosting_deep": TreeModel,
    "boosting_wide": TreeModel,
    FOREST: ForestModel,
    "gradient_boosting": TreeModel,
    LINEAR: LinearRegressionModel,
}


@dataclass
class EnsembleConfig:
    """Member settings. The two large boosters stop early on the held-out rows: boosting_deep
    grows regularised trees level by level, boosting_wide the leaf of the largest gain next.
    gradient_boosting grows plain trees level by level for all its rounds."""

    members: tuple[str, ...] = tuple(MODEL_CLASSES)
    boosting_rounds: int = 500
    boosting_rate: float = 0.05
    boosting_patience: int = 50
    deep_depth: int = 6
    deep_child_rows: int = 3
    wide_leaves: int = 31
    wide_child_rows: int = 20
    l1: float = 0.1
    l2: float = 1.0
    subsample: float = 0.8
    column_share: float = 0.8
    forest_trees: int = 100
    forest_depth: int = 15
    forest_min_rows: int = 2
    gradient_rounds: int = 100
    gradient_depth: int = 6
    gradient_rate: float = 0.1
    ridge_alpha: float = 1.0
    auto_weight: bool = True
    seed: int = 42


def small_config(**changes) -> EnsembleConfig:
    """Few shallow trees, for tests and interactive use."""
    settings = dict(
        boosting_rounds=8,
        boosting_rate=0.3,
        deep_depth=3,
        wide_leaves=6,
        forest_trees=12,
        forest_depth=6,
        gradient_rounds=6,
        gradient_depth=3,
        gradient_rate=0.3,
    )
    return EnsembleConfig(**{**settings, **changes})


def _forest(config: EnsembleConfig) -> ForestSettings:
    return ForestSettings(
        trees=config.forest_trees,
        depth=config.forest_depth,
        child_rows=config.forest_min_rows,
        seed=config.seed,
    )


def _boosting(name: str, config: EnsembleConfig) -> TreeSettings:
    """Settings of a boosted member."""
    large = TreeSettings(
        rounds=config.boosting_rounds,
        rate=config.boosting_rate,
        l1=config.l1,
        l2=config.l2,
        subsample=config.subsample,
        column_share=config.column_share,
        patience=config.boosting_patience,
        seed=config.seed,
    )
    if name == "boosting_deep":
        return replace(large, depth=config.deep_depth, child_rows=config.deep_child_rows)
    if name == "boosting_wide":
        return replace(large, depth=None, leaves=config.wide_leaves, child_rows=config.wide_child_rows)
    if name == "gradient_boosting":
        return replace(
            large,
            rounds=config.gradient_rounds,
            rate=config.gradient_rate,
            depth=config.gradient_depth,
            l1=0.0,
            l2=0.0,
            child_rows=1,
            column_share=1.0,
            patience=None,
        )
    raise ValueError(f"unknown member: {name}")


def _ridge(ridge_penalty: float) -> LinearRegression:
    return LinearRegression(
        featuresCol="features",
        labelCol=LABEL,
        predictionCol=_raw(LINEAR),
        elasticNetParam=0.0,
        regParam=ridge_penalty,
        standardization=False,
        solver="normal",
    )


def _importances(model: Model | TreeModel | ForestModel) -> list[float]:
    if isinstance(model, (TreeModel, ForestModel)):
        return model.importances
    return [float(value) for value in model.featureImportances.toArray()]


def _raw(name: str) -> str:
    return f"raw_{name}"


def member_column(name: str) -> str:
    return f"member_{name}"


def inverse_error_weights(
    df: DataFrame, truth: str, guesses: dict[str, str], auto_weight: bool = True
) -> dict[str, float]:
    """Weights from the inverse mean absolute error of each member; one scan."""
    if not auto_weight or len(guesses) < 2:
        return {name: 1.0 / len(guesses) for name in guesses}
    row = df.agg(
        *[F.avg(F.abs(F.col(c) - F.col(truth))).alias(name) for name, c in guesses.items()]
    ).first()
    inverse = {name: 1.0 / (row[name] + MAE_FLOOR) for name in guesses}
    total = sum(inverse.values())
    return {name: value / total for name, value in inverse.items()}


def weighted_mean(guesses: dict[str, str], weights: dict[str, float]) -> Column:
    """Weighted mean of the member columns; members without a weight do not count."""
    total = sum(weights.get(name, 0.0) for name in guesses)
    combined = F.lit(0.0)
    for name, column in guesses.items():
        combined = combined + F.col(column) * weights.get(name, 0.0)
    return combined / total if total > 0 else combined


@dataclass
class Ensemble:
    members: dict[str, Model | TreeModel | ForestModel]
    weights: dict[str, float] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)

    @property
    def guesses(self) -> dict[str, str]:
        return {name: member_column(name) for name in self.members}

    def predict(self, vectors: DataFrame, output: str = "ensemble") -> DataFrame:
        """Add each member's prediction, never below zero, and their weighted mean."""
        df = self.predict_members(vectors)
        return df.withColumn(output, weighted_mean(self.guesses, self.weights))

    def predict_members(self, vectors: DataFrame) -> DataFrame:
        df = vectors
        for model in self.members.values():
            df = model.transform(df)
        clamped = {
            member_column(name): F.greatest(F.col(_raw(name)), F.lit(0.0))
            for name in self.members
        }
        return df.withColumns(clamped).drop(*[_raw(name) for name in self.members])

    def importance(self, spark: SparkSession, member: str | None = None) -> DataFrame:
        """Feature importance, weighted over the tree members, with its rank.

        A model-sized table: one row per feature.
        """
        trees = {
            n: m for n, m in self.members.items() if n != LINEAR and member in (None, n)
        }
        held = sum(self.weights.get(n, 0.0) for n in trees)
        totals = [0.0] * len(self.features)
        for name, model in trees.items():
            share = self.weights.get(name, 0.0) / held if held > 0 else 0.0
            for place, value in enumerate(_importances(model)):
                totals[place] += share * float(value)
        ordered = sorted(zip(self.features, totals), key=lambda entry: (-entry[1], entry[0]))
        rows = [(name, value, place) for place, (name, value) in enumerate(ordered, start=1)]
        return constant_table(spark, rows, "feature importance rank")

    def save(self, spark: SparkSession, path: str) -> None:
        for name, model in self.members.items():
            if isinstance(model, (TreeModel, ForestModel)):
                model.save(spark, f"{path}/members/{name}")
            else:
                model.write().overwrite().save(f"{path}/members/{name}")
        state = {
            "members": list(self.members),
            "spark_ml": [n for n, m in self.members.items() if isinstance(m, Model)],
            "weights": self.weights,
            "features": self.features,
        }
        frame = constant_table(spark, [(json.dumps(state),)], "state")
        frame.write.mode("overwrite").parquet(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        members = {}
        for name in state["members"]:
            kind, folder = MODEL_CLASSES[name], f"{path}/members/{name}"
            # Forests saved before they were grown here are Spark ML's.
            if name == FOREST and name in state.get("spark_ml", [FOREST]):
                kind = RandomForestRegressionModel
            own = kind in (TreeModel, ForestModel)
            members[name] = kind.load(spark, folder) if own else kind.load(folder)
        return Ensemble(members, state["weights"], state["features"])


def fit_ensemble(vectors: DataFrame, features: list[str], config: EnsembleConfig) -> Ensemble:
    """Fit the members on rows that are not held out and weigh them on those that are.

    ``vectors`` has ``features``, ``label``, the boolean ``held_out`` and, for tree members, a
    whole number ``key`` by which rows are drawn; it is read by every member, so it should be
    cached.
    """
    fitted_on = vectors.where(~F.col(HELD_OUT))
    moments = fitted_on.agg(
        F.count(F.lit(1)).alias("rows"), F.stddev_pop(LABEL).alias("sd")
    ).first()
    # The normal equations take one scan. They scale the label by its population
    # deviation, so this penalty equals alpha on the plain sum of squares.
    penalty = config.ridge_alpha * (moments["sd"] or 0.0) / max(moments["rows"], 1)
    edges = quantile_edges(fitted_on, len(features), TreeSettings.bins)

    def fitted(name: str) -> Model | TreeModel | ForestModel:
        named = {"name": _raw(name), "label": LABEL, "held_out": HELD_OUT, "key": KEY}
        if name == LINEAR:
            return _ridge(penalty).fit(fitted_on)
        if name == FOREST:
            settings = _forest(config)
            return fit_forest(
                fitted_on, settings, **named, edges=forest_edges(fitted_on, edges, settings.bins)
            )
        boosting = _boosting(name, config)
        return fit_trees(
            vectors if boosting.patience else fitted_on, boosting, **named, edges=edges
        )

    # Members don't depend on each other, and the jobs of one leave cores to the others.
    with ThreadPoolExecutor(max(len(config.members), 1)) as pool:
        found = pool.map(inheritable_thread_target(vectors.sparkSession)(fitted), config.members)
        members = dict(zip(config.members, found))
    ensemble = Ensemble(members, features=features)
    held = ensemble.predict_members(vectors.where(HELD_OUT))
    ensemble.weights = inverse_error_weights(held, LABEL, ensemble.guesses, config.auto_weight)
    return ensemble

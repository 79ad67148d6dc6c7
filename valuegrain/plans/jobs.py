"""Batch jobs: build features, train with reports, evaluate with a quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.operators.clean import fit_cleaning
from valuegrain.operators.ensemble import EnsembleConfig
from valuegrain.operators.evaluate import regression_metrics, rounded_metrics
from valuegrain.plans.features import fit_features
from valuegrain.plans.value_model import (
    TEST,
    Training,
    ValueModel,
    evaluate_value_model,
    train_value_model,
)
from valuegrain.session import keep, prepare_session
from valuegrain.sources.files import (
    read_customers,
    read_customers_csv,
    write_report,
    write_table,
)


def load_customers(spark: SparkSession, path: str) -> DataFrame:
    """Customer table from a CSV file or a parquet folder."""
    return read_customers_csv(spark, path) if path.endswith(".csv") else read_customers(spark, path)


def feature_job(spark: SparkSession, source: str, target: str) -> None:
    """Clean a customer table, derive every feature and store them with the profile."""
    customers = keep(load_customers(prepare_session(spark), source))
    cleaned = keep(fit_cleaning(customers).apply(customers))
    plan = fit_features(cleaned)
    write_table(plan.transform(cleaned, exact_ranks=True), f"{target}/features")
    plan.profile.save(spark, f"{target}/profile")
    cleaned.unpersist()
    customers.unpersist()


def training_job(
    spark: SparkSession,
    source: str,
    target: str,
    config: EnsembleConfig | None = None,
    *,
    split: str = "temporal",
    **options,
) -> Training:
    """Train, then store the model, its test rows, metrics and feature importance."""
    customers = load_customers(prepare_session(spark), source)
    training = train_value_model(customers, config, split=split, **options)
    training.model.save(spark, f"{target}/model")
    write_table(training.part(TEST), f"{target}/test")
    write_report(training_report(training), f"{target}/metrics")
    write_report(training.importance(), f"{target}/importance")
    return training


def evaluation_job(spark: SparkSession, model: str, labelled: str, target: str) -> bool:
    """Judge a stored model on stored labelled rows and report whether it passes."""
    report = evaluate_value_model(ValueModel.load(spark, model), load_customers(spark, labelled))
    for name, table in report.items():
        write_report(table, f"{target}/{name}")
    return bool(report["metrics"].first()["passed"])


def scoring_job(spark: SparkSession, model: str, source: str, target: str) -> None:
    """Score a customer table and store it by segment, ready for pruned reads."""
    customers = load_customers(prepare_session(spark), source)
    scored = ValueModel.load(spark, model).score(customers)
    write_table(scored, target, partition_by="predicted_segment")


def training_report(training: Training) -> DataFrame:
    """Metrics of every member and the ensemble on the test rows, with the sizes of both parts.

    Members are weighed on some of the training rows, which count as such.
    """
    tested = F.count_if(F.col("split") == TEST)
    sizes = training.rows.agg((F.count("*") - tested).alias("n_train"), tested.alias("n_test")).first()
    counts = {name: F.lit(sizes[name]).cast("long") for name in ("n_train", "n_test")}
    return training.metrics(TEST).withColumns(counts)


def script_metrics(scored: DataFrame, n_train: int) -> DataFrame:
    """Rounded metrics of a scored labelled table, with the sizes of both parts."""
    metrics = rounded_metrics(regression_metrics(scored))
    return metrics.withColumns({"n_train": F.lit(n_train).cast("long"), "n_test": F.col("rows")})

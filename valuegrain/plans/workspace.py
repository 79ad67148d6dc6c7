"""Shared intermediate tables of one data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.functions.scoring import heuristic_value, request_confidence
from valuegrain.operators.clean import Cleaning, fit_cleaning
from valuegrain.operators.ensemble import EnsembleConfig
from valuegrain.operators.segments import score_columns
from valuegrain.plans.features import FeaturePlan, fit_features
from valuegrain.plans.value_model import Training, train_value_model
from valuegrain.session import keep, prepare_session
from valuegrain.sources.customer_views import CustomerViews, publish_customers
from valuegrain.sources.facts import build_customers, read_facts

TRAINING_CUTOFF = "2000-01-01"


def heuristic_scores(df: DataFrame) -> DataFrame:
    """Score customers without a model: value, segment, cost and confidence."""
    have = set(df.columns)

    def rate(name: str):
        return F.col(name) if name in have else F.lit(None).cast("double")

    value = heuristic_value(
        F.col("total_spent"),
        F.col("total_orders"),
        F.col("days_since_last_purchase"),
        rate("email_engagement_rate"),
        rate("return_rate"),
    )
    scored = df.withColumns(score_columns(value))
    return scored.withColumn("confidence", request_confidence(F.col("predicted_clv")))


class Workspace:
    """Builds each table once and keeps the ones that several queries read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare_session(spark)
        self.folder = folder
        self._views: dict[tuple[str, ...], CustomerViews] = {}

    @cached_property
    def facts(self) -> dict[str, DataFrame]:
        return read_facts(self.spark, self.folder)

    def build(self, **options) -> DataFrame:
        return build_customers(self.facts, **options)

    @cached_property
    def customers(self) -> DataFrame:
        return keep(self.build())

    @cached_property
    def cleaning(self) -> Cleaning:
        return fit_cleaning(self.customers)

    @cached_property
    def cleaned(self) -> DataFrame:
        return keep(self.cleaning.apply(self.customers))

    @cached_property
    def plan(self) -> FeaturePlan:
        return fit_features(self.cleaned)

    @cached_property
    def scored(self) -> DataFrame:
        return keep(heuristic_scores(self.cleaned))

    def views(self, columns: list[str]) -> CustomerViews:
        """The named columns of the scored customers, published once for lookups and search."""
        key = tuple(columns)
        if key not in self._views:
            self._views[key] = publish_customers(self.scored.select(*columns))
        return self._views[key]

    @cached_property
    def labelled(self) -> DataFrame:
        """Customers as of the training cutoff with their lifetime value."""
        return keep(self.build(cutoff=TRAINING_CUTOFF, with_target=True))

    @cached_property
    def judged(self) -> DataFrame:
        return keep(heuristic_scores(self.labelled))

    def config(self) -> EnsembleConfig:
        return EnsembleConfig()

    @cached_property
    def training(self) -> Training:
        return train_value_model(self.labelled, self.config())


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """The workspace of a folder in this application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, folder)
    return _OPEN[key]

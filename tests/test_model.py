import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from valuegrain.operators.ensemble import (
    EnsembleConfig,
    fit_ensemble,
    inverse_error_weights,
    small_config,
    weighted_mean,
)
from valuegrain.operators.split import random_split, temporal_split
from valuegrain.plans.jobs import evaluation_job, scoring_job, training_job
from valuegrain.plans.value_model import TEST, ValueModel, evaluate_value_model
from valuegrain.streaming.scoring import customer_stream, score_stream

TINY = small_config(
    boosting_rounds=6, forest_trees=4, forest_depth=4, gradient_rounds=3, deep_depth=4
)


@pytest.fixture(scope="module")
def trained(spark, space, tmp_path_factory):
    root = tmp_path_factory.mktemp("model")
    space.labelled.write.parquet(str(root / "customers"))
    training = training_job(
        spark, str(root / "customers"), str(root / "out"), TINY, split="temporal"
    )
    return root, training


def test_members_weights_and_predictions(trained):
    _, training = trained
    ensemble = training.model.ensemble
    assert set(ensemble.members) == set(TINY.members)
    assert sum(ensemble.weights.values()) == pytest.approx(1.0)
    low = training.scored(TEST).agg(F.min("predicted_clv"), F.count("*")).first()
    assert low[0] >= 0 and low[1] == training.part(TEST).count()


def test_boosters_keep_several_trees_that_lower_the_held_out_error(trained):
    _, training = trained
    for name in ("boosting_deep", "boosting_wide", "gradient_boosting"):
        assert training.model.ensemble.members[name].trees > 1
    deep = training.model.ensemble.members["boosting_deep"]
    assert min(deep.errors) == deep.errors[-1] < deep.errors[1] < deep.errors[0]


def test_metrics_have_a_row_per_member(trained):
    _, training = trained
    rows = {r.model: r for r in training.metrics(TEST).collect()}
    assert set(rows) == {*TINY.members, "ensemble"}
    assert len({round(r.mae, 9) for r in rows.values()}) == len(rows)


def test_importance_is_ranked_and_sums_to_one(trained):
    _, training = trained
    rows = training.importance(None).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    values = [r.importance for r in rows]
    assert values == sorted(values, reverse=True)
    assert sum(values) == pytest.approx(1.0)
    assert training.importance().count() == 15


def test_saved_model_scores_alike_and_passes_through_the_jobs(spark, trained):
    root, training = trained
    model = str(root / "out" / "model")
    loaded = ValueModel.load(spark, model)
    columns = ["customer_id", "predicted_clv", "predicted_segment", "recommended_cac"]
    test = training.part(TEST)
    assert sorted(loaded.score(test).select(*columns).collect()) == sorted(
        training.model.score(test).select(*columns).collect()
    )
    passed = evaluation_job(spark, model, str(root / "out" / "test"), str(root / "judged"))
    report = evaluate_value_model(loaded, test)["metrics"].first()
    assert passed == (report.r2 >= 0.5)
    stored = spark.read.json(str(root / "judged" / "metrics")).first()
    assert stored.mae == pytest.approx(report.mae)
    scoring_job(spark, model, str(root / "customers"), str(root / "scored"))
    assert spark.read.parquet(str(root / "scored")).count() == training.rows.count()


def test_scoring_has_no_shuffle_and_needs_no_target(trained, capsys):
    _, training = trained
    scored = training.model.score(training.part(TEST).drop("actual_clv"))
    scored.explain()
    assert "Exchange" not in capsys.readouterr().out
    with_target = training.scored(TEST).select("customer_id", "predicted_clv")
    assert sorted(scored.select("customer_id", "predicted_clv").collect()) == sorted(
        with_target.collect()
    )


def test_interval_surrounds_the_value(trained):
    _, training = trained
    rows = training.model.score_with_interval(training.part(TEST), 0.99)
    assert rows.where("interval_lower > predicted_clv or interval_upper < predicted_clv").isEmpty()
    assert rows.where("interval_lower < 0 or member_count <> 5").isEmpty()


def test_stream_scores_equal_batch_scores(spark, trained, tmp_path):
    root, training = trained
    source = spark.read.parquet(str(root / "customers"))
    stream = customer_stream(spark, str(root / "customers"), source.schema, files_per_batch=1)
    out = str(tmp_path / "out")
    score_stream(stream, training.model.score, out, str(tmp_path / "state")).awaitTermination()
    columns = ["customer_id", "predicted_clv", "predicted_segment"]
    streamed = spark.read.parquet(out).select(*columns)
    assert sorted(streamed.collect()) == sorted(
        training.model.score(source).select(*columns).collect()
    )


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = x @ [40.0, -10.0, 5.0] + 300 + rng.normal(size=80)
    rows = [(Vectors.dense(v), float(t), i % 5 == 0) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["features", "label", "held_out"])
    config = EnsembleConfig(members=("ridge",), ridge_alpha=4.0)
    model = fit_ensemble(df, ["a", "b", "c"], config).members["ridge"]
    kept = np.array([i % 5 != 0 for i in range(80)])
    xc, yc = x[kept] - x[kept].mean(0), y[kept] - y[kept].mean()
    expected = np.linalg.solve(xc.T @ xc + 4.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), expected, rtol=1e-6)


def test_inverse_error_weights(spark):
    df = spark.createDataFrame([(10.0, 11.0, 12.0), (20.0, 19.0, 18.0)], "y double, a double, b double")
    weights = inverse_error_weights(df, "y", {"a": "a", "b": "b"})
    assert weights["a"] == pytest.approx(2 / 3, rel=1e-5)
    mixed = df.select(weighted_mean({"a": "a", "b": "b"}, weights).alias("m")).first()["m"]
    assert mixed == pytest.approx(11 + 1 / 3, rel=1e-5)
    equal = inverse_error_weights(df, "y", {"a": "a", "b": "b"}, auto_weight=False)
    assert equal == {"a": 0.5, "b": 0.5}


def test_temporal_split_is_disjoint_complete_and_ordered(space):
    labelled = temporal_split(space.labelled, sample_rows=40).cache()
    total = space.labelled.count()
    sizes = {r.split: r["count"] for r in labelled.groupBy("split").count().collect()}
    assert sizes["train"] == total * 70 // 100
    assert sizes["train"] + sizes["validation"] == total * 85 // 100
    assert sum(sizes.values()) == total
    days = {
        r.split: (r.low, r.high)
        for r in labelled.groupBy("split")
        .agg(F.min("first_purchase_date").alias("low"), F.max("first_purchase_date").alias("high"))
        .collect()
    }
    assert days["train"][1] <= days["validation"][0]
    assert days["validation"][1] <= days["test"][0]
    with pytest.raises(ValueError):
        temporal_split(space.labelled, percents=(70, 20, 20))


def test_random_split_is_stable_under_repartitioning(space):
    first = random_split(space.labelled).select("customer_id", "split")
    again = random_split(space.labelled.repartition(11)).select("customer_id", "split")
    assert sorted(first.collect()) == sorted(again.collect())
    share = first.where("split = 'test'").count() / first.count()
    assert 0.1 < share < 0.3

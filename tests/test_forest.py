"""The random forest against plain versions and Spark ML's."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor

from valuegrain.operators import forest, trees
from valuegrain.operators.ensemble import EnsembleConfig, Ensemble, fit_ensemble
from valuegrain.operators.forest import ForestSettings, fit_forest, forest_edges
from valuegrain.operators.trees import quantile_edges

NAMED = dict(name="out", label="label", held_out="held_out", key="key")


def table(spark, rows=300, width=7, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, rows), rng.integers(0, 2, rows), rng.normal(size=(rows, width - 2)).round(1)])
    y = (40 + 6 * x[:, 0] + 25 * (x[:, 2] > 0.2) * x[:, 1] + 4 * x[:, 3] + rng.normal(size=rows)).round(2)
    data = [(i, Vectors.dense(v), float(t), i % 5 == 0) for i, (v, t) in enumerate(zip(x, y))]
    return x.astype(float), y, spark.createDataFrame(data, ["key", "features", "label", "held_out"])


def edges_of(df, width=7):
    return forest_edges(df, quantile_edges(df, width, 64), 64)


def error(x, y, rows):
    return float(((y[rows] - y[rows].mean()) ** 2).sum()) if len(rows) else 0.0


def plain_tree(x, y, rows, depth, least):
    """Predictions of a plain tree for its own rows."""
    out = np.full(len(y), y[rows].mean())
    best = (1e-6, None, None)
    for f in range(x.shape[1]) if depth and len(rows) >= 2 * least else ():
        for cut in sorted(set(x[rows, f]))[:-1]:
            left = x[rows, f] <= cut
            if min(left.sum(), (~left).sum()) >= least:
                gain = error(x, y, rows) - error(x, y, rows[left]) - error(x, y, rows[~left])
                if gain > best[0] + 1e-6:
                    best = (gain, f, cut)
    if best[1] is not None:
        left = x[rows, best[1]] <= best[2]
        for side in (rows[left], rows[~left]):
            out[side] = plain_tree(x, y, side, depth - 1, least)[side]
    return out


def test_a_single_tree_equals_a_plain_one(spark):
    x, y, df = table(spark)
    model = fit_forest(df, ForestSettings(trees=1, depth=5), **NAMED, edges=edges_of(df))
    assert model.values(x) == pytest.approx(plain_tree(x, y, np.arange(300), 5, 2), rel=1e-6)


def alike(model):
    """What identifies a forest, whatever the order of its nodes."""
    return [sorted(zip(t.features, t.bins, t.values, t.gains)) for t in model.grown]


def test_trees_do_not_depend_on_partitions_chunks_or_where_passes_end(spark, monkeypatch):
    x, _, df = table(spark)
    edges, settings = edges_of(df), ForestSettings(trees=5, depth=7)
    once = fit_forest(df.coalesce(1), settings, **NAMED, edges=edges)
    monkeypatch.setattr(trees, "CHUNK_ROWS", 16)
    monkeypatch.setattr(trees, "TASK_ROWS", 40)
    monkeypatch.setattr(forest, "CELLS_HELD", 200)
    monkeypatch.setattr(forest, "WAVE_BYTES", 10_000)
    again = fit_forest(df.repartition(5), settings, **NAMED, edges=edges)
    assert alike(once) == alike(again) and min(len(t.features) for t in once.grown) > 20
    assert once.values(x).tolist() == again.values(x).tolist()
    # Passes alone give the same trees as well.
    monkeypatch.setattr(trees, "TASK_ROWS", 0)
    assert alike(fit_forest(df.repartition(3), settings, **NAMED, edges=edges)) == alike(once)


def test_the_forest_of_an_ensemble_does_not_depend_on_partitions(spark):
    x, _, df = table(spark)
    config = EnsembleConfig(members=("random_forest",), forest_trees=8, forest_depth=6)
    names = [f"f{i}" for i in range(7)]
    one, other = (fit_ensemble(d, names, config).predict(df) for d in (df.coalesce(1), df.repartition(6)))
    a, b = ({r["key"]: r["ensemble"] for r in scored.select("key", "ensemble").collect()} for scored in (one, other))
    assert a == b and len(set(a.values())) > 100


def test_few_rows_split_as_from_histograms():
    rng = np.random.default_rng(2)
    settings = ForestSettings(bins=16)
    for size in (2, 3, 5, 8, 13, 32):
        nodes = 40
        bins = rng.integers(0, 4 if size < 6 else 16, (nodes * size, 6)).astype(np.uint8)
        times = rng.integers(1, 4, nodes * size).astype(float)
        parts = rng.integers(-1000, 1000, nodes * size) * times
        columns = np.tile([0, 2, 3, 5], (nodes, 1))
        rows = np.arange(nodes * size).reshape(nodes, size)
        place = np.repeat(np.arange(nodes), size)
        sums = forest.histograms(bins, rows.ravel(), place, columns, parts, times, settings)
        counted = forest.counted_splits(*sums, columns, settings, 1.0)
        padded = np.pad(rows, ((0, 0), (0, 3)), constant_values=-1)
        few = forest.sorted_splits(bins, padded, columns, parts, times, settings, 1.0)
        worth = counted[2] > 0
        assert worth.any() and np.array_equal(worth, few[2] > 0) and np.array_equal(counted[2], few[2])
        assert all(np.array_equal(a[worth], b[worth]) for a, b in zip(counted[:2], few[:2]))


def test_rows_and_features_are_drawn_as_by_spark():
    settings = ForestSettings()
    times = np.stack([forest.times_drawn(np.arange(20_000), settings, t) for t in range(4)])
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.04
    assert abs(np.corrcoef(times)[0, 1]) < 0.03
    drawn = forest.features_drawn(np.arange(1, 5000), 20, settings, 3)
    assert drawn.shape == (4999, 7) and (np.diff(drawn, axis=1) > 0).all()
    shares = np.bincount(drawn.ravel(), minlength=20) / 4999
    assert np.abs(shares - 7 / 20).max() < 0.03


def test_it_predicts_about_as_well_as_the_forest_of_spark(spark):
    _, _, df = table(spark, 1500)
    fitted, held = df.where("not held_out"), df.where("held_out")
    model = fit_forest(fitted, ForestSettings(trees=40, depth=10), **NAMED, edges=edges_of(fitted))
    other = RandomForestRegressor(numTrees=40, maxDepth=10, minInstancesPerNode=2, seed=42, predictionCol="out").fit(fitted)
    share = "1 - sum(pow(label - out, 2)) / (count(*) * var_pop(label)) as r2"
    here, there = (m.transform(held).selectExpr(share).first()["r2"] for m in (model, other))
    assert here > 0.8 and abs(here - there) < 0.05
    assert sum(model.importances) == pytest.approx(1.0)
    assert np.abs(np.array(model.importances) - other.featureImportances.toArray()).max() < 0.1


def test_rare_values_have_a_split_and_many_values_quantiles(spark):
    rows = [(Vectors.dense([float(i != 7), float(i)]),) for i in range(400)]
    df = spark.createDataFrame(rows, ["features"]).repartition(3)
    edges = forest_edges(df, quantile_edges(df, 2, 64), 64)
    assert edges[0] == [0.5] and len(edges[1]) == 63


def test_without_rows_or_gains_the_mean_is_left(spark):
    _, _, df = table(spark)
    flat, edges = df.selectExpr("key", "features", "7D as label", "held_out"), [[0.0]] * 7
    assert fit_forest(flat, ForestSettings(trees=3), **NAMED, edges=edges).values(np.zeros((2, 7))).tolist() == [7.0, 7.0]
    assert fit_forest(df.limit(0), ForestSettings(trees=3), **NAMED, edges=edges).values(np.zeros((1, 7))).tolist() == [0.0]


def test_a_forest_survives_storage_also_one_of_spark(spark, tmp_path):
    x, _, df = table(spark)
    config = EnsembleConfig(members=("random_forest",), forest_trees=4, forest_depth=5)
    ensemble = fit_ensemble(df, [f"f{i}" for i in range(7)], config)
    ensemble.save(spark, str(tmp_path / "now"))
    loaded = Ensemble.load(spark, str(tmp_path / "now")).members["random_forest"]
    known = ensemble.members["random_forest"]
    assert np.array_equal(loaded.values(x), known.values(x)) and loaded.importances == known.importances
    old = RandomForestRegressor(numTrees=2, predictionCol="raw_random_forest").fit(df)
    ensemble.members["random_forest"] = old
    ensemble.save(spark, str(tmp_path / "old"))
    back = Ensemble.load(spark, str(tmp_path / "old"))
    assert back.members["random_forest"].toDebugString == old.toDebugString

import numpy as np
from pyspark.ml.linalg import Vectors

from valuegrain.operators.ridge import fit_ridge


def test_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = x @ [40.0, -10.0, 5.0] + 300 + rng.normal(size=80)
    rows = [(Vectors.dense(v), float(t)) for v, t in zip(x, y)]
    df = spark.createDataFrame(rows, ["features", "label"]).repartition(5)
    model = fit_ridge(df, "label", 3, alpha=4.0)
    xc, yc = x - x.mean(0), y - y.mean()
    expected = np.linalg.solve(xc.T @ xc + 4.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients, expected, rtol=1e-9)
    assert np.isclose(model.intercept, y.mean() - x.mean(0) @ expected)
    assert fit_ridge(df.limit(0), "label", 3).coefficients == [0.0] * 3

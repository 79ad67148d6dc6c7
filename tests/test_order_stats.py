import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from valuegrain.operators.order_stats import order_statistics, quantiles, value_quantiles
from valuegrain.operators.profile import cut_ranks
from valuegrain.operators.ranks import average_percent_rank, fitted_percent_rank
from valuegrain.operators.rfm import quantile_score


def ranked(pdf, column):
    return pdf.sort_values([column, "customer_id"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; another column is continuous."""
    rng = random.Random(5)
    rows = [
        (f"c{i:05d}", 7 if i % 3 == 0 else rng.randint(0, 40), rng.random() * 100)
        for i in range(3000)
    ]
    rng.shuffle(rows)
    pdf = pd.DataFrame(rows, columns=["customer_id", "orders", "spent"])
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


@pytest.mark.parametrize("sample_rows", [5000, 900, 200])
def test_every_sample_size_finds_the_exact_keys(skewed, sample_rows):
    pdf, df = skewed
    ranks = {"orders": [0, 599, 1500, 2999], "spent": [1, 2250]}
    sizes = {"orders": 3000, "spent": 3000}
    found = order_statistics(df, ranks, sizes, sample_rows=sample_rows)
    for column, wanted in ranks.items():
        ordered = ranked(pdf, column)
        for rank in wanted:
            expected = (ordered[column][rank], ordered["customer_id"][rank])
            assert found[column][rank] == expected


def test_copies_of_one_row_do_not_stall(spark):
    rows = [("same", 5.0)] * 900 + [(f"r{i:04d}", float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "customer_id string, x double").repartition(5)
    ordered = sorted((x, i) for i, x in rows)
    wanted = [3, 6, 400, 905, 906, 1700]
    found = order_statistics(df, {"x": wanted}, {"x": 1800}, sample_rows=120)["x"]
    assert {r: found[r] for r in wanted} == {r: ordered[r] for r in wanted}


def test_quantiles_equal_numpy_and_skip_nulls(spark, skewed):
    pdf, df = skewed
    holed = df.withColumn("spent", F.when(F.col("spent") > 10, F.col("spent")))
    got = quantiles(holed, {"spent": (0.01, 0.5, 0.99), "orders": (0.75,)}, sample_rows=500)
    kept = pdf.spent[pdf.spent > 10]
    for share in (0.01, 0.5, 0.99):
        assert got["spent"][share] == pytest.approx(np.quantile(kept, share), rel=1e-12)
    assert got["orders"][0.75] == np.quantile(pdf.orders, 0.75)


def test_quantiles_by_digits_equal_quantiles(spark, skewed):
    _, df = skewed
    odd = [0.0, -0.0, -1.5, 1e-320, -1e300, float("inf"), float("-inf"), float("nan"), None, 7.0]
    rows = [(f"r{i:03d}", odd[i % 10], -i, float(i % 3) - 1) for i in range(101)]
    mixed = spark.createDataFrame(rows, "customer_id string, odd double, whole long, few double").repartition(4)
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.8, 1.0)
    for table, columns in ((df, ["orders", "spent"]), (mixed, ["odd", "whole", "few"])):
        sizes = table.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
        wanted = dict.fromkeys(columns, shares)
        assert repr(value_quantiles(table, wanted, sizes)) == repr(quantiles(table, wanted)).replace("-0.0", "0.0")


def test_quantiles_of_many_columns_build_a_small_plan(spark, monkeypatch):
    built, col = [], F.col
    df = spark.range(300).select(*[((F.col("id") * (k + 1)) % 211 - 50.5).alias(f"c{k}") for k in range(60)])
    wanted = {c: (0.25, 0.5, 0.75) for c in df.columns}
    monkeypatch.setattr(F, "col", lambda name: built.append(name) or col(name))
    got = value_quantiles(df, wanted, dict.fromkeys(df.columns, 300))
    assert len(built) <= 60
    known = df.toPandas()
    assert all(got[c][s] == pytest.approx(np.quantile(known[c], s)) for c in df.columns for s in wanted[c])


def test_quantiles_of_an_empty_column_are_null(spark):
    df = spark.createDataFrame([("a", None)], "customer_id string, x double")
    assert quantiles(df, {"x": (0.5,)}) == {"x": {0.5: None}}
    assert value_quantiles(df, {"x": (0.5,)}, {"x": 0}) == {"x": {0.5: None}}


@pytest.mark.parametrize("rows", [5, 6, 9, 10, 101, 399])
def test_quantile_score_matches_the_pandas_rank_cut(spark, rows):
    pdf = pd.DataFrame(
        {
            "customer_id": [f"c{i:04d}" for i in range(rows)],
            "x": [float(i * 7919 % 13) for i in range(rows)],
        }
    )
    expected = pd.qcut(pdf.x.rank(method="first"), 5, labels=range(1, 6)).astype(float)
    df = spark.createDataFrame(pdf)
    wanted = cut_ranks(rows, 5)
    keys = order_statistics(df, {"x": wanted}, {"x": rows})["x"]
    scored = df.select("customer_id", quantile_score("x", [keys[r] for r in wanted]).alias("s"))
    got = scored.toPandas().sort_values("customer_id")["s"].reset_index(drop=True)
    assert got.tolist() == expected.tolist()


@pytest.mark.parametrize("buckets", [1, 2, 20])
@pytest.mark.parametrize("column", ["orders", "spent"])
def test_percent_rank_equals_pandas(skewed, column, buckets):
    pdf, df = skewed
    edges = np.quantile(pdf[column], np.arange(1, buckets) / buckets, method="lower").tolist()
    got = average_percent_rank(df, column, "share", size=3000, edges=edges).toPandas()
    assert len(got) == 3000
    assert np.allclose(got[column].rank(pct=True), got["share"], atol=1e-12)


def test_percent_rank_keeps_rows_with_a_null(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("b", None), ("c", 2.0)], "customer_id string, x double"
    )
    got = average_percent_rank(df, "x", "share", size=2, edges=[1.0, 1.0])
    assert {r.customer_id: r.share for r in got.collect()} == {"a": 0.5, "b": None, "c": 1.0}


def test_fitted_percent_rank_is_close(skewed):
    pdf, df = skewed
    edges = np.quantile(pdf.spent, np.arange(1, 200) / 200, method="lower").tolist()
    got = fitted_percent_rank(df, "spent", "share", edges=edges).toPandas()
    assert (got.spent.rank(pct=True) - got.share).abs().max() < 0.006


def test_columns_are_ranked_together_in_fine_buckets(skewed, monkeypatch):
    from valuegrain.operators import ranks

    pdf, df = skewed
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 20)
    monkeypatch.setattr(ranks, "SALT_ROWS", 100)
    columns = ["orders", "spent"]
    edges = {c: sorted(pdf[c].quantile([k / 20 for k in range(1, 20)]).tolist()) for c in columns}
    outputs = {c: f"{c}_share" for c in columns}
    ranked = ranks.average_percent_ranks(df, outputs, sizes=dict.fromkeys(columns, 3000), edges=edges)
    got = ranked.toPandas()
    assert len(got) == len(pdf)
    for c in columns:
        assert np.allclose(got[c].rank(pct=True), got[outputs[c]], atol=1e-12)

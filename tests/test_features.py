import datetime
import itertools
import math

import pytest
from pyspark.sql import functions as F

from valuegrain.operators.catalogue import feature_catalogue, feature_names, feature_summary
from valuegrain.operators.rfm import rfm_segment
from valuegrain.plans.features import FAMILIES, fit_features

DAY = datetime.date


@pytest.fixture(scope="module")
def three(five_customers):
    """Fewer rows than bins, one of them with its last purchase before its first."""
    idle = F.create_map(
        F.lit("C001"), F.lit(10), F.lit("C002"), F.lit(60), F.lit("C003"), F.lit(5)
    )
    return (
        five_customers.limit(3)
        .drop("acquisition_cost", "customer_segment", "actual_clv")
        .withColumn("days_since_last_purchase", idle[F.col("customer_id")])
        .cache()
    )


def by_id(df):
    return {r.customer_id: r for r in df.collect()}


def test_small_population_uses_the_fixed_edges(three):
    rows = by_id(fit_features(three).transform(three))
    scores = {k: (r.recency_score, r.frequency_score, r.monetary_score) for k, r in rows.items()}
    assert scores == {"C001": (4.0, 3.0, 4.0), "C002": (3.0, 2.0, 2.0), "C003": (5.0, 4.0, 5.0)}
    assert rows["C003"].rfm_string == "545"
    assert rows["C003"].rfm_segment == "Champions"
    assert rows["C001"].rfm_weighted == pytest.approx(4 * 0.2 + 3 * 0.35 + 4 * 0.45)
    assert rows["C002"].recency_normalized == 0.0
    assert rows["C002"].recency_ratio == -1.0


def test_behaviour_by_hand(three):
    row = by_id(fit_features(three).transform(three))["C001"]
    assert row.purchase_velocity == pytest.approx(5 / (180 / 30.44))
    assert row.orders_per_week == pytest.approx(5 / (180 / 7))
    assert row.avg_days_between_purchases == 45.0
    assert row.purchase_regularity == pytest.approx(1 / 2.5)
    assert row.aov_deviation == 0.0
    assert row.engagement_score == pytest.approx(0.7 * 0.6 + 0.95 * 0.4)
    assert (row.email_engagement_bucket, row.return_risk, row.is_returner) == (4.0, 0, 0)
    assert (row.tenure_bucket, row.is_multi_category) == (3.0, 1)
    assert row.value_frequency_score == pytest.approx(math.log1p(5))


def test_absent_inputs_skip_their_features(three):
    columns = fit_features(three).transform(three).columns
    assert "cac_efficiency" not in columns
    assert "first_purchase_dow" not in columns
    assert "days_to_christmas" not in columns
    assert "source_quality_score" in columns


def test_unknown_family_is_refused(three):
    with pytest.raises(ValueError):
        fit_features(three).transform(three, ("rfm", "horoscope"))


def test_every_family_yields_108_columns_and_the_catalogue(space):
    df = space.plan.transform(space.cleaned, FAMILIES, exact_ranks=True)
    assert len(df.columns) - len(space.cleaned.columns) == 108
    assert len(feature_names()) == 74
    assert set(feature_names()) <= set(df.columns)
    assert len(feature_names("rfm")) == 10


def test_features_do_not_depend_on_partitioning(space):
    columns = ["customer_id", "rfm_string", "churn_risk_score", "is_premium", "outlier_score"]
    columns.append("total_orders_percentile")
    tables = []
    for partitions in (1, 13):
        df = space.cleaned.repartition(partitions)
        out = fit_features(df).transform(df, exact_ranks=True).select(*columns)
        tables.append(sorted(out.collect()))
    assert tables[0] == tables[1]


def test_new_rows_reuse_the_fitted_statistics(space):
    """One row scores as it does within the whole table."""
    whole = space.plan.transform(space.cleaned)
    one = whole.select("customer_id").first()["customer_id"]
    alone = space.plan.transform(space.cleaned.where(F.col("customer_id") == one))
    assert alone.first() == whole.where(F.col("customer_id") == one).first()


def test_segment_rules_reach_nine_names(spark):
    triples = [tuple(map(float, t)) for t in itertools.product(range(1, 6), repeat=3)]
    df = spark.createDataFrame(triples, "r double, f double, m double")
    names = df.select(rfm_segment(F.col("r"), F.col("f"), F.col("m")).alias("name")).distinct()
    assert names.count() == 9


@pytest.fixture(scope="module")
def edge_rows(spark):
    schema = (
        "customer_id string, first_purchase_date date, last_purchase_date date, "
        "total_orders long, total_spent double, avg_order_value double, "
        "days_since_first_purchase int, days_since_last_purchase int, num_categories int, "
        "acquisition_source string, campaign_type string, acquisition_cost double, "
        "email_engagement_rate double, return_rate double"
    )
    leap, eve = DAY(2024, 2, 29), DAY(2023, 12, 31)
    rows = [
        ("a", leap, leap, 0, 0.0, 0.0, 0, 0, 1, "Radio", "Jingle", 0.0, 0.0, 0.0),
        ("b", None, None, 4, 80.0, 20.0, None, 9, 2, "Email", "None", 8.0, 1.0, 0.31),
        ("c", eve, eve, 4, 80.0, 20.0, 900, 400, 6, "Meta Ads", "Brand", None, 0.2, 0.1),
        ("d", DAY(2023, 12, 25), eve, 1, 9.0, 9.0, 31, 8, 3, None, None, 9.0, 0.21, 0.16),
        ("e", DAY(2023, 1, 2), eve, 2, 9.0, 4.5, 30, 8, 3, "Direct", "None", 1.0, 0.5, 0.2),
    ]
    df = spark.createDataFrame(rows, schema).cache()
    return by_id(fit_features(df).transform(df, exact_ranks=True))


def test_zero_and_null_edges(edge_rows):
    a, b = edge_rows["a"], edge_rows["b"]
    assert (a.tenure_bucket, a.recency_ratio, a.email_engagement_bucket) == (0.0, 0.0, 0.0)
    assert (a.has_cac, a.cac_roi) == (0, 0.0)
    assert a.cac_efficiency == 9.0
    assert b.purchase_velocity == 0.0
    assert (b.email_engagement_bucket, b.return_risk, b.tenure_bucket) == (5.0, 2, 0.0)
    assert b.cac_efficiency == 10.0
    assert (edge_rows["d"].tenure_bucket, edge_rows["e"].tenure_bucket) == (2.0, 1.0)


def test_unknown_names_take_the_default(edge_rows):
    a, d = edge_rows["a"], edge_rows["d"]
    assert (a.source_quality_score, a.campaign_effectiveness) == (0.5, 0.5)
    assert (a.source_numeric, a.campaign_numeric) == (2, 0)
    assert (d.source_quality_score, d.is_paid_acquisition) == (0.5, 0)


def test_holiday_edges(edge_rows):
    a, b, c, d = (edge_rows[k] for k in "abcd")
    assert a.days_to_independence_day == 126
    assert a.days_to_valentines == -15 + 365
    assert a.near_valentines == 0
    assert {b.days_to_christmas, b.days_to_new_year} == {180}
    assert (b.near_christmas, b.near_any_holiday) == (0, 0)
    assert (c.near_christmas, c.near_boxing_day, c.near_new_year) == (1, 1, 0)
    assert (d.days_to_christmas, d.near_christmas, d.is_peak_season) == (0, 1, 1)
    assert d.days_to_boxing_day == 1 and d.near_boxing_day == 0
    assert edge_rows["e"].near_new_year == 1


def test_calendar_edges(edge_rows):
    a, c = edge_rows["a"], edge_rows["c"]
    assert (a.first_purchase_dow, a.first_purchase_is_weekend) == (3, 0)
    assert (a.first_purchase_season, a.first_purchase_quarter) == (1, 1)
    assert (c.first_purchase_dow, c.first_purchase_is_weekend) == (6, 1)
    assert (c.first_purchase_season, c.first_purchase_quarter) == (1, 4)


def test_column_without_spread_has_no_z_score(spark):
    rows = [(f"c{i}", 3, float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "customer_id string, total_orders long, total_spent double")
    out = fit_features(df).transform(df, exact_ranks=True)
    assert "total_orders_zscore" not in out.columns
    assert "total_spent_zscore" in out.columns
    assert sorted(r.frequency_score for r in out.collect()) == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_catalogue_follows_the_table(spark):
    assert feature_catalogue(spark, []).count() == 0
    present = feature_catalogue(spark, ["rfm_score", "cac_roi", "cac_efficiency", "shoe_size"])
    counts = {r.category: r.features for r in feature_summary(present).collect()}
    assert counts == {"rfm": 1, "acquisition": 2}
    whole = {r.category: r.features for r in feature_summary(feature_catalogue(spark)).collect()}
    assert whole == {
        "rfm": 10, "behavioral": 20, "temporal": 14, "statistical": 10, "acquisition": 9,
        "interaction": 11,
    }

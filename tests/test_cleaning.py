import pytest
from pyspark.sql import functions as F

from valuegrain.errors import NotEnoughData
from valuegrain.operators.clean import (
    fill_numeric_gaps,
    fit_cleaning,
    present_gaps,
    require_rows,
)
from valuegrain.operators.encode import (
    align,
    fit_encoder,
    numeric_features,
    script_features,
    training_columns,
)
from valuegrain.operators.quality import (
    quality_categorical,
    quality_missing,
    quality_numeric,
    quality_overview,
)
from valuegrain.operators.validate import (
    apply_contract,
    quarantined_rows,
    valid_rows,
    with_violations,
)


def test_clean_rows_stay_and_rates_are_bounded(five_customers):
    cleaned = fit_cleaning(five_customers).apply(five_customers).collect()
    assert len(cleaned) == 5
    assert all(0 <= r.email_engagement_rate <= 1 and 0 <= r.return_rate <= 1 for r in cleaned)


def test_imputation_uses_median_and_smallest_mode(spark):
    rows = [("a", 1, 2.0, "y"), ("b", None, 4.0, "x"), ("c", 4, None, None), ("d", 2, 9.0, None)]
    df = spark.createDataFrame(
        rows, "customer_id string, total_orders int, total_spent double, acquisition_source string"
    )
    cleaning = fit_cleaning(df)
    assert cleaning.fills == {"total_orders": 2.0, "total_spent": 4.0, "acquisition_source": "x"}
    rows = {r.customer_id: r for r in cleaning.apply(df).collect()}
    assert rows["b"].total_orders == 2.0
    assert rows["c"].acquisition_source == "x"


def test_all_null_text_becomes_unknown(spark):
    df = spark.createDataFrame([("a", None)], "customer_id string, campaign_type string")
    assert fit_cleaning(df).fills == {"campaign_type": "Unknown"}


def test_tails_are_capped_after_imputation(spark):
    rows = [(f"c{i:03d}", float(i)) for i in range(100)] + [("big", 1e6)]
    df = spark.createDataFrame(rows, "customer_id string, total_spent double")
    cleaning = fit_cleaning(df)
    low, high = cleaning.bounds["total_spent"]
    assert (low, high) == (0.0, 99.0 + 1.5 * 98.0)
    assert cleaning.apply(df).agg(F.max("total_spent")).first()[0] == high


def test_counts_and_rates_are_clipped(spark):
    rows = [("a", -3, -5, 1.4, -0.2), ("b", 2, 8, 0.5, 0.5)]
    schema = (
        "customer_id string, total_orders int, days_since_last_purchase int, "
        "email_engagement_rate double, return_rate double"
    )
    df = spark.createDataFrame(rows, schema)
    row = fit_cleaning(df).apply(df).where("customer_id = 'a'").first()
    assert tuple(row)[1:] == (0, 0, 1.0, 0.0)


def test_gap_fills(spark):
    df = spark.createDataFrame(
        [("a", None, float("nan"), None)],
        "customer_id string, n int, x double, campaign_type string",
    )
    assert fill_numeric_gaps(df).first()[1:3] == (0, 0.0)
    assert present_gaps(df).first()["campaign_type"] == "None"


def test_minimum_rows(five_customers):
    require_rows(five_customers, 5)
    with pytest.raises(NotEnoughData) as caught:
        require_rows(five_customers, 6)
    assert (caught.value.required, caught.value.available) == (6, 5)


def test_contract_defaults_and_derived_order_value(spark):
    df = spark.createDataFrame(
        [("a", 4, 80.0, 0.0, None, None), ("b", 0, 0.0, 0.0, 2, "Email")],
        "customer_id string, total_orders int, total_spent double, avg_order_value double, "
        "num_categories int, acquisition_source string",
    )
    a, b = apply_contract(df).orderBy("customer_id").collect()
    assert (a.avg_order_value, a.num_categories, a.acquisition_source) == (20.0, 1, "Direct")
    assert b.avg_order_value == 0.0


def test_violations_name_the_broken_rules(spark, five_customers):
    odd = five_customers.limit(1).withColumns(
        {
            "customer_id": F.lit("no spaces!"),
            "return_rate": F.lit(1.2),
            "acquisition_source": F.lit("Radio"),
            "days_since_last_purchase": F.lit(200),
            "total_spent": F.lit(None).cast("double"),
        }
    )
    checked = with_violations(five_customers.unionByName(odd))
    assert valid_rows(checked).count() == 5
    broken = quarantined_rows(checked).first()["violations"]
    assert sorted(broken) == [
        "acquisition_source:value",
        "customer_id:pattern",
        "days:order",
        "return_rate:range",
        "total_spent:required",
    ]


def test_quality_report(spark):
    rows = [("a", 1.0, "x"), ("a", 1.0, "x"), ("b", 4.0, None), ("c", None, "y")]
    df = spark.createDataFrame(rows, "customer_id string, total_spent double, campaign_type string")
    assert tuple(quality_overview(df).first()) == (4, 3, 1)
    missing = {r.column_name: (r.missing_values, r.missing_percentage)
               for r in quality_missing(df).collect()}
    assert missing["campaign_type"] == (1, 25.0)
    stats = quality_numeric(df).first()
    assert (stats["min"], stats["max"], stats["mean"], stats["median"]) == (1.0, 4.0, 2.0, 1.0)
    counts = {r.value: r.records for r in quality_categorical(df).collect()}
    assert counts == {"x": 2, "y": 1}


def test_quality_of_an_empty_table(spark):
    df = spark.createDataFrame([], "customer_id string, total_spent double")
    assert tuple(quality_overview(df).first()) == (0, 2, 0)
    assert quality_missing(df).first()["missing_percentage"] is None
    assert quality_numeric(df).first()["median"] is None


def test_feature_selection_and_alignment(five_customers):
    kept = training_columns(five_customers).columns
    assert not {"customer_id", "actual_clv", "customer_segment"} & set(kept)
    assert set(numeric_features(five_customers)) == set(script_features(five_customers))
    aligned = align(five_customers, ["return_rate", "unseen"]).first()
    assert aligned.asDict() == {"return_rate": 0.05, "unseen": 0.0}


def test_encoder_drops_the_first_level_and_scales_by_quartiles(five_customers):
    encoder = fit_encoder(
        five_customers,
        numeric=["total_orders"],
        categorical=["acquisition_source"],
    )
    assert encoder.features == [
        "total_orders",
        "acquisition_source_Email",
        "acquisition_source_Google Ads",
        "acquisition_source_Meta Ads",
    ]
    assert (encoder.centers["total_orders"], encoder.scales["total_orders"]) == (5.0, 5.0)
    assert encoder.scales["acquisition_source_Email"] == 1.0
    unseen = five_customers.limit(1).withColumn("acquisition_source", F.lit("Rad'io"))
    assert list(encoder.encode(unseen).first()) == [5.0, 0.0, 0.0, 0.0]

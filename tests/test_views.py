import datetime

import pytest
from pyspark.sql import functions as F

from valuegrain.errors import CustomerNotFound
from valuegrain.functions.scoring import interval_columns, response_cac, value_segment
from valuegrain.operators import audience
from valuegrain.operators.customers import (
    customer_page,
    filter_customers,
    find_customer,
    search_customers,
    sort_customers,
    top_customers,
)
from valuegrain.operators.dashboard import (
    dashboard_kpis,
    segment_distribution,
    source_distribution,
    value_histogram,
)
from valuegrain.operators.evaluate import (
    regression_metrics,
    segment_accuracy,
    segment_errors,
    with_quality_gate,
)
from valuegrain.operators.segments import segment_analysis, segment_rows, segment_summary
from valuegrain.sources.exports import audience_export, write_audiences


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        ("C001", 850.0, "High-CLV", 255.0, "Meta Ads"),
        ("C002", 120.0, "Low-CLV", 36.0, "Email"),
        ("C003", 500.0, "Growth-Potential", 150.0, None),
        ("C004", 75.0, "Low-CLV", 22.5, "Google Ads"),
        ("C005", 300.0, "Growth-Potential", 90.0, "Email"),
    ]
    schema = (
        "customer_id string, predicted_clv double, predicted_segment string, "
        "recommended_cac double, acquisition_source string"
    )
    return spark.createDataFrame(rows, schema).cache()


def ids(df):
    return [r.customer_id for r in df.collect()]


def test_filters(scored):
    assert ids(filter_customers(scored, segment="Low-CLV")) == ["C002", "C004"]
    assert ids(filter_customers(scored, source="Email", min_value=120, max_value=299)) == ["C002"]


def test_label_columns_serve_where_nothing_is_predicted(five_customers):
    assert ids(filter_customers(five_customers, segment="Low-CLV", min_value=100)) == ["C002"]


def test_sorting_and_unknown_column(scored):
    assert ids(sort_customers(scored))[:2] == ["C001", "C003"]
    assert ids(sort_customers(scored, "acquisition_source", descending=False))[-1] == "C003"
    assert sort_customers(scored, "nonsense") is scored


def test_pages_cover_every_customer_once(scored):
    seen, page = [], 1
    while True:
        rows, info = customer_page(scored, page=page, page_size=2)
        seen += ids(rows)
        state = info.first()
        assert state.total == 5
        if not state.has_more:
            break
        page += 1
    assert (page, seen) == (3, ["C001", "C003", "C005", "C002", "C004"])


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("sort_by", ["value", "label", "customer_id"])
def test_late_pages_equal_the_sorted_table(spark, sort_by, descending):
    """Ties, missing values last, and pages within, at and behind the end."""
    rows = [(f"C{i:02}", None if i % 7 == 0 else float(i % 4), "ab"[i % 2] if i % 5 else None) for i in range(30)]
    table = spark.createDataFrame(rows, "customer_id string, value double, label string").cache()
    want = ids(sort_customers(table, sort_by, descending))
    for page in (2, 4, 7, 8):
        got = customer_page(
            table, page=page, page_size=4, sort_by=sort_by, descending=descending, shallow_rows=0
        ).rows
        assert ids(got) == want[4 * page - 4 : 4 * page], page
    assert ids(customer_page(table, page=9, page_size=4, sort_by=sort_by, shallow_rows=0).rows) == []


def test_page_size_is_clamped(scored):
    info = customer_page(scored, page=0, page_size=5000).info.first()
    assert (info.page, info.page_size, info.has_more) == (1, 1000, False)


def test_lookup_search_and_top(scored):
    assert find_customer(scored, "C003").first()["acquisition_source"] == "None"
    with pytest.raises(CustomerNotFound):
        find_customer(scored, "C999")
    assert ids(search_customers(scored, "aDs")) == ["C001", "C004"]
    assert ids(search_customers(scored, "c00", segment="Low-CLV")) == ["C002", "C004"]
    assert ids(top_customers(scored, 2)) == ["C001", "C003"]


def test_segment_limits_are_inclusive(spark):
    df = spark.createDataFrame([(500.0,), (499.99,), (150.0,), (149.99,)], "v double")
    names = [r[0] for r in df.select(value_segment(F.col("v"))).collect()]
    assert names == ["High-CLV", "Growth-Potential", "Growth-Potential", "Low-CLV"]


def test_segment_summary_adds_up(scored):
    rows = {r.segment: r for r in segment_summary(scored).collect()}
    assert {k: r.customers for k, r in rows.items()} == {
        "High-CLV": 1, "Growth-Potential": 2, "Low-CLV": 2
    }
    assert sum(r.percentage for r in rows.values()) == pytest.approx(100)
    assert rows["Low-CLV"].avg_recommended_cac == 29.25


def test_empty_segments_and_tables_keep_their_rows(scored):
    only_high = segment_rows(scored, "High-CLV")
    rows = {r.segment: r for r in segment_summary(only_high).collect()}
    assert (rows["Low-CLV"].customers, rows["Low-CLV"].total_predicted_value) == (0, 0.0)
    none = scored.where("false")
    assert [r.customers for r in segment_summary(none).collect()] == [0, 0, 0]
    assert dashboard_kpis(none).first()["high_clv_percentage"] == 0.0
    assert {r.customers for r in value_histogram(none).collect()} == {0}
    budget = audience.budget_allocation(none, 1000.0).collect()
    assert [r.expected_acquisitions for r in budget] == [0, 0, 0]


def test_segment_analysis_has_a_grand_total(scored):
    rows = {r.segment: r for r in segment_analysis(scored).collect()}
    assert (rows["All"].customers, rows["All"].total_predicted_value) == (5, 1845.0)


def test_dashboard(scored):
    kpis = dashboard_kpis(scored).first()
    assert (kpis.total_customers, kpis.avg_clv, kpis.high_clv_percentage) == (5, 369.0, 20.0)
    assert {r.segment: r.customers for r in segment_distribution(scored).collect()} == {
        "High-CLV": 1, "Growth-Potential": 2, "Low-CLV": 2
    }
    assert {r.acquisition_source for r in source_distribution(scored).collect()} == {
        "Meta Ads", "Google Ads", "Email"
    }
    buckets = [(r.bucket, r.customers) for r in value_histogram(scored).collect()]
    assert buckets == [
        ("$0-100", 1), ("$100-250", 1), ("$250-500", 1), ("$500-1000", 2), ("$1000+", 0)
    ]


def test_audience_advice(scored):
    rows = {r.customer_id: r for r in audience.audiences(scored).collect()}
    assert len(rows) == 5
    assert rows["C001"].targeting_priority == "Primary"
    assert rows["C004"].bidding_strategy == "Strict Cost Caps"


@pytest.mark.parametrize("ratio, cost, roas", [(None, 300.0, 3.33), (0, 300.0, 3.33), (0.25, 250.0, 4.0)])
def test_cost_band(spark, ratio, cost, roas):
    bands = audience.cac_band(F.lit(1000.0), ratio)
    row = spark.range(1).select(*[c.alias(n) for n, c in bands.items()]).first()
    assert (row.optimal_cac, row.expected_roas) == (cost, roas)
    assert (row.max_cac, row.min_cac) == (400.0, 150.0)


def test_response_cost_is_capped(spark):
    row = spark.range(1).select(response_cac(F.lit(0.011)).alias("c")).first()
    assert row.c == 0.0 or row.c <= 0.0055


def test_budget(scored):
    allocation = audience.budget_allocation(scored, 10_000.0)
    rows = {r.segment: r for r in allocation.collect()}
    assert [rows[s].budget for s in ("High-CLV", "Growth-Potential", "Low-CLV")] == [
        5000.0, 3500.0, 1500.0
    ]
    assert rows["High-CLV"].expected_acquisitions == 19
    assert rows["High-CLV"].expected_revenue == 19 * 850.0
    totals = audience.budget_totals(allocation, 10_000.0).first()
    assert totals.total_expected_acquisitions == sum(r.expected_acquisitions for r in rows.values())
    assert totals.blended_roas == pytest.approx(totals.total_expected_revenue / 1e4, abs=0.005)
    for refused in (0, -1, 10_000_001):
        with pytest.raises(ValueError):
            audience.budget_allocation(scored, refused)


def test_full_strategy(scored):
    strategy = audience.full_strategy(scored, 10_000.0)
    sizes = {r.campaign: r.source_size for r in strategy["lookalikes"].collect()}
    assert sizes == {"prospecting": 1, "expansion": 3, "testing": 2}
    assert strategy["campaigns"].count() == 3
    assert {r.segment: r.customer_count for r in strategy["audience_sizes"].collect()} == {
        "High-CLV": 1, "Growth-Potential": 2, "Low-CLV": 2
    }


def test_export_keeps_available_fields(scored, tmp_path):
    day = datetime.date(2026, 1, 15)
    one = audience_export(scored, "Low-CLV", ["customer_id", "phone"], day)
    assert one.columns == ["customer_id", "export_date", "segment"]
    assert [tuple(r) for r in one.collect()][0] == ("C002", "2026-01-15", "Low-CLV")
    with pytest.raises(ValueError):
        audience_export(scored, "VIP")
    write_audiences(audience_export(scored), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("segment=*")) == [
        "segment=Growth-Potential", "segment=High-CLV", "segment=Low-CLV"
    ]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [(100.0, 110.0), (200.0, 190.0), (600.0, 630.0), (0.0, 5.0)],
        "actual_clv double, predicted_clv double",
    )
    row = with_quality_gate(regression_metrics(df)).first()
    errors = [10.0, -10.0, 30.0, 5.0]
    mean = 225.0
    spread = sum((v - mean) ** 2 for v in (100.0, 200.0, 600.0, 0.0))
    assert row.rows == 4
    assert row.mae == pytest.approx(sum(map(abs, errors)) / 4)
    assert row.rmse == pytest.approx((sum(e * e for e in errors) / 4) ** 0.5)
    assert row.r2 == pytest.approx(1 - sum(e * e for e in errors) / spread)
    assert row.mape == pytest.approx((0.1 + 0.05 + 0.05) / 3 * 100)
    assert row.passed
    assert segment_accuracy(df).first()[0] == 1.0
    assert {r.segment: r.customers for r in segment_errors(df).collect()} == {
        "Low-CLV": 2, "Growth-Potential": 1, "High-CLV": 1
    }


def test_interval_by_hand(spark):
    members = [F.lit(90.0), F.lit(110.0)]
    columns = interval_columns(F.lit(100.0), members, 0.95)
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    assert row.uncertainty_std == pytest.approx(10.0)
    assert (row.interval_lower, row.interval_upper) == (pytest.approx(80.4), pytest.approx(119.6))
    assert (row.uncertainty_category, row.member_spread) == ("High", 20.0)
    lonely = interval_columns(F.lit(100.0), [F.lit(100.0)])
    row = spark.range(1).select(*[c.alias(n) for n, c in lonely.items()]).first()
    assert (row.interval_lower, row.interval_upper, row.uncertainty_score) == (75.0, 125.0, 0.5)
    assert row.member_spread is None

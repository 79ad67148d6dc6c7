"""Stored customer views against the plain operators, and what their plans read."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from valuegrain.errors import CustomerNotFound
from valuegrain.operators.customers import filter_customers, find_customer, search_customers
from valuegrain.sources.customer_views import grams_of, publish_customers, term_grams

COLUMNS = "customer_id string, predicted_clv double, predicted_segment string, acquisition_source string"
TABLE = [
    ("CUST_0001", 10.0, "Low-CLV", "Meta Ads"),
    ("CUST_0002", 200.0, "Growth-Potential", "Google Ads"),
    ("ads_0003", 900.0, "High-CLV", "Email"),
    ("ads_0004", 901.0, "High-CLV", "Meta Ads"),
    ("ads_0004", 901.0, "High-CLV", "Meta Ads"),
    ("é漢字x_5", 5.0, "Low-CLV", "ÄRGER direkt"),
    ("ab", None, "odd/segment", "x"),
    ("CUST_0006", 1.0, "", ""),
    ("CUST_0007", 1.0, None, None),
    (None, 3.0, "Low-CLV", "Email"),
]
TERMS = ["ads", "ADS", "0004", "cust_000", "meta a", "mail", "漢字x", "rger D", "nothing", "a", "", "ab", "_", "000", "ads_0003x"]


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(TABLE, COLUMNS).cache()


@pytest.fixture(scope="module")
def views(table):
    return publish_customers(table, buckets=4)


def test_rows_come_back_whole(table, views):
    assert views.rows.columns == table.columns
    assert rows_of(views.rows) == rows_of(table)


@pytest.mark.parametrize("term", TERMS)
def test_search_equals_the_scan(table, views, term):
    assert rows_of(views.search(term)) == rows_of(search_customers(table, term))


@pytest.mark.parametrize("segment", ["High-CLV", "odd/segment", "Low-CLV", "none such"])
def test_segments_equal_the_scan(table, views, segment):
    assert rows_of(views.search("ads", segment)) == rows_of(search_customers(table, "ads", segment))
    assert rows_of(views.filtered(segment=segment)) == rows_of(filter_customers(table, segment=segment))


def test_other_limits_filter_as_before(table, views):
    limits = {"source": "Meta Ads", "min_value": 10.0, "max_value": 900.5}
    assert rows_of(views.filtered(**limits)) == rows_of(filter_customers(table, **limits))


def test_lookup(table, views):
    for key in ("CUST_0002", "ads_0004", "é漢字x_5"):
        assert rows_of(views.find(key)) == rows_of(find_customer(table, key))
    assert views.lookup("CUST_9").collect() == []
    with pytest.raises(CustomerNotFound):
        views.find("CUST_9")


def test_empty_table(spark):
    empty = publish_customers(spark.createDataFrame([], COLUMNS), buckets=2)
    assert empty.rows.collect() == empty.search("ads").collect() == empty.search("a").collect() == []
    assert empty.lookup("x").collect() == []


def test_grams(spark):
    got = spark.createDataFrame([("abcab",), ("ab",), ("",), ("漢字é",)], "v string").select(grams_of(F.col("v"))).collect()
    assert [sorted(r[0]) for r in got] == [["abc", "bca", "cab"], [], [], ["漢字é"]]
    assert term_grams("abcabc") == ["abc", "bca", "cab"] and term_grams("ab") == []


def scans_of(df):
    """Of each scan: the last part of its path, its partition filters and its pushed filters."""
    jvm = df.sparkSession.sparkContext._jvm
    text = jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = []
    for block in re.split(r"\n\n+", text):
        if "Scan parquet" in block and "Location" in block:
            where = re.search(r"Location: .*?/(rows|postings|counts)\]", block).group(1)
            part = re.search(r"PartitionFilters: (.*)", block)
            pushed = re.search(r"PushedFilters: (.*)", block)
            found.append((where, part and part.group(1), pushed and pushed.group(1)))
    return found


def test_plans_skip_folders(views):
    [(where, part, pushed)] = scans_of(views.lookup("CUST_0002"))
    assert where == "rows" and "id_bucket" in part and "EqualTo(customer_id,CUST_0002)" in pushed
    [(where, part, _)] = scans_of(views.filtered(segment="High-CLV"))
    assert where == "rows" and "segment_part" in part
    [(where, part, pushed)] = scans_of(views.matches("ads_0003"))
    assert where == "postings" and "folder" in part and "EqualTo(gram," in pushed
    scans = scans_of(views.search("ads_0003"))
    assert sorted(s[0] for s in scans) == ["postings", "rows"]
    assert all("id_bucket" in part for where, part, _ in scans if where == "rows")


def test_the_rarest_trigram_is_read(views):
    [(_, _, pushed)] = scans_of(views.matches("cust_0006"))
    assert "006" in pushed


def test_rows_carry_bloom_filters(spark, tmp_path):
    """The filters' bits make files larger than the same rows written without."""
    many = spark.range(40_000).select(
        F.format_string("C%08d", F.col("id") * 2).alias("customer_id"),
        F.col("id").cast("double").alias("predicted_clv"),
        F.lit("Low-CLV").alias("predicted_segment"),
        F.lit("Email").alias("acquisition_source"),
    )
    views = publish_customers(many, buckets=2)
    assert views.lookup("C00000100").count() == 1 and views.lookup("C00000101").count() == 0
    plain = str(tmp_path / "plain")
    views.stored.repartition(2, "id_bucket").sortWithinPartitions("customer_id").write.parquet(plain)
    size = lambda path: sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))
    # Ten bits for each id tell an absent one with an error of one in a hundred.
    assert size(views.path.removeprefix("file:") + "/rows") > size(plain) + 40_000 * 10 // 8

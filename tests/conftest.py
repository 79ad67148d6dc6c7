import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from valuegrain.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _small_space(session):
    """The workspace of the fixture folder, which trains a small ensemble."""
    from valuegrain.operators.ensemble import small_config
    from valuegrain.plans.workspace import workspace

    space = workspace(session, SF_DIR)
    space.config = small_config
    return space


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 8, str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    _small_space(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def space(spark):
    return _small_space(spark)


@pytest.fixture(scope="session")
def five_customers(spark):
    """Five hand-written customers with known labels and values."""
    columns = (
        "customer_id string, total_orders long, total_spent double, avg_order_value double, "
        "days_since_first_purchase int, days_since_last_purchase int, "
        "acquisition_source string, campaign_type string, email_engagement_rate double, "
        "return_rate double, num_categories int, acquisition_cost double, "
        "customer_segment string, actual_clv double"
    )
    rows = [
        ("C001", 5, 500.0, 100.0, 180, 10, "Meta Ads", "Prospecting", 0.7, 0.05, 3, 45.0,
         "High-CLV", 850.0),
        ("C002", 2, 100.0, 50.0, 30, 20, "Google Ads", "Retargeting", 0.3, 0.15, 1, 50.0,
         "Low-CLV", 120.0),
        ("C003", 10, 1500.0, 150.0, 365, 5, "Email", "None", 0.9, 0.02, 5, 5.0,
         "High-CLV", 2500.0),
        ("C004", 1, 50.0, 50.0, 7, 7, "Direct", "None", 0.1, 0.30, 1, 0.0, "Low-CLV", 55.0),
        ("C005", 7, 800.0, 114.28, 200, 15, "Meta Ads", "Brand", 0.6, 0.08, 4, 40.0,
         "Growth-Potential", 1100.0),
    ]
    return spark.createDataFrame(rows, columns)

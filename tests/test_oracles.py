"""Every registered query with SQL must equal it on the small fixture."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    assert compare(got, duck.execute(oracle_sql()[name]).df()) == "ok"


def test_every_query_is_registered_and_the_entry_runs(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0

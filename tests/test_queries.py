"""Every query with SQL gives DuckDB's rows; the others give rows."""

import pytest
from oracle import connect, differences

from gradloom.plans import answers, artifacts, evaluation, preparation, registry, streaming, training  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF), con, registry.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0

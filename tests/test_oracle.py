"""Every query of the engine that has SQL, at the smallest size."""

import pytest

from quillmark.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    compare(registry.QUERIES[name](spark, SF), con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0

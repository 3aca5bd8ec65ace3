"""Every registered query of the engine's own operators against its DuckDB form."""

import pytest
from conftest import same_rows

from lacuna import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, sf, name):
    same_rows(registry.QUERIES[name](spark, sf), duck.sql(registry.ORACLES[name]))


def test_all_queries_have_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(registry.ORACLES) <= set(e.oracle_sql())

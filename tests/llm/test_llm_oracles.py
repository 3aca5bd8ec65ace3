"""Training-data queries that SQL can express, against DuckDB; all others for shape over the smallest tables."""

import pytest
from conftest import same_rows

from lacuna.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, sf, name):
    same_rows(registry.QUERIES[name](spark, sf), duck.sql(registry.ORACLES[name]))


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in registry.QUERIES} and "pipeline" in names

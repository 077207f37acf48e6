"""Every registered query runs on the smallest tables; those with SQL agree with DuckDB."""

import pytest
from conftest import DATA

from phonolith import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_agrees_with_sql(name, same):
    same(plans.QUERIES[name], plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(name, spark):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and all(0 <= r["min"] <= r["median"] <= r["max"] <= 1 for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every registered query with SQL gives the rows that SQL gives."""

import pytest

from quillon.plans.catalogue import QUERIES, SQL
from tests.oracle import rows_by_sql, rows_of


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, name):
    assert rows_of(QUERIES[name](spark, data)) == rows_by_sql(data, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

from __future__ import annotations

import pytest

from strandline import catalog
from tests.compare import assert_same

QUERIES, SQL = catalog.collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, data, duck):
    assert_same(QUERIES[name](spark, data), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(name, spark, data):
    assert QUERIES[name](spark, data).limit(1).count() == 1


def test_entry_points(spark):
    import __spark_entry__ as entry_points

    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0

from __future__ import annotations

import pytest

from strandline.llm import oracles, queries
from tests.compare import assert_same

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, data, duck):
    assert_same(queries.queries()[name](spark, data), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_without_sql_has_rows(name, spark, data):
    assert queries.queries()[name](spark, data).limit(1).count() == 1

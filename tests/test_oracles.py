"""Every query with SQL gives the rows of its SQL; the others give rows."""

import pytest

from tests.compare import SF, connection, rows
from tracemill.plans import all_queries

PAIRS = all_queries()


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_query(spark, duck, name):
    query, sql = PAIRS[name]
    found = query(spark, SF).toPandas()
    if sql is None:
        assert len(found) > 0
        return
    assert rows(found) == rows(duck.execute(sql).df())

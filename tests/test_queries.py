"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest
import sql

from plumbline import queries


@pytest.fixture(scope="module")
def duck():
    return sql.connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    rows = sql.same_rows(spark, duck, queries.QUERIES[name], queries.ORACLE[name])
    assert rows > 0 or name == "tolerant_matches"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

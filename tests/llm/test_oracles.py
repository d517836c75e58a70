"""The training-data queries that SQL can express."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])
import sql  # noqa: E402

from plumbline.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert sql.same_rows(spark, sql.connect(), queries.QUERIES[name], queries.ORACLE[name]) > 0

import pytest

from tests.oracle import compare
from tracemill.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.sql()))
def test_against_sql(spark, small, name):
    compare(spark, small, queries.queries()[name], sql.sql()[name])

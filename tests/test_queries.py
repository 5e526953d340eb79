"""Every core query: against its SQL, or at least that it runs."""

import pytest

import __spark_entry__
from tests.oracle import compare
from tracemill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.sql()))
def test_against_sql(spark, small, name):
    compare(spark, small, catalog.queries()[name], catalog.sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.sql())))
def test_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

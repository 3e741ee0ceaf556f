"""Every registered query at the smallest scale factor, the SQL ones against DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
# one class only in the test split at this scale, or too few rows to fit on
FITTED = set(entry.queries()) - set(entry.oracle_sql())


def test_every_key_is_listed_once_and_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 75


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(entry.queries()[name](spark, SMALL), connect(SMALL), entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 150

"""Every registered query against its SQL at the smallest scale."""

import compare_oracle
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    problem, *_ = compare_oracle.compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert problem is None, problem


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

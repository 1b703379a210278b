"""Every registered query against DuckDB over the same tables."""

import pytest
from oracle import assert_same

from runledger.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_duckdb(spark, small, name):
    assert_same(catalogue.queries()[name](spark, small), small, catalogue.oracle_sql()[name])

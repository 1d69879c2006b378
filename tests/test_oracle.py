"""Every registered query against its DuckDB oracle on the smallest tables
(row count, column names, order-insensitive value hash)."""

import pytest

from kiln.plans.catalog import oracle_sql, queries
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
_SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(queries()[name](spark, SF), con, _SQL[name])
    assert r["cols_match"], r
    assert r["rows_spark"] == r["rows_oracle"], r
    assert r["hash_match"], r


def test_every_query_has_an_oracle():
    assert set(queries()) == set(_SQL)

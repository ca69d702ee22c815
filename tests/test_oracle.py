"""Every registered query with an oracle must return the oracle's rows
(DuckDB over the same parquet), at sf0.001."""
import pytest

from quillon.plans.checker import compare, duckdb_connection
from quillon.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    r = compare(df, oracle_sql()[name], con)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r["first_mismatch"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())

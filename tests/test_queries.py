"""Every registered query, against its SQL where there is one, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_names_line_up():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    problem, _, _ = compare(spark, duck, sf_dir, QUERIES[name], SQL[name])
    assert problem is None


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["account_id", "month", "total_income", "total_expense", "net_flow"]
    assert df.count() > 0

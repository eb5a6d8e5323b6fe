"""Every catalogue query that has an SQL twin gives the same rows, types and names."""

import pytest

import __spark_entry__ as entry
from conftest import ROOT
from oracle_compare import differences, duck

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, ROOT), con, SQL[name]) == []


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["fold"] for r in sorted(rows)] == [1, 2, 3, 4]
    right = sum(r["n_correct_predictions"] for r in rows) / sum(r["n_valid_predictions"] for r in rows)
    assert right == pytest.approx(0.644, abs=5e-4)

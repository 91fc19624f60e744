"""Every registered query against its SQL, or against itself where SQL cannot say it."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, SQL[name]) is None


#: The smallest documents hold nothing like a secret, so that the scan rightly gives no row; those ten times as many do.
LARGER = {"op5_secrets": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    if name in LARGER:
        assert QUERIES[name](spark, sf).count() == 0
    assert QUERIES[name](spark, LARGER.get(name, sf)).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["item_id"] for r in rows} and all(1 <= r["rank"] <= 10 for r in rows)

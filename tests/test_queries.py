"""Every registered query against its SQL on the smallest tables."""

import pytest

import compare
from tauframe.plans import catalog, oracles

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), oracles.sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows = compare.spark_rows(QUERIES[name](spark, SF))
    if name in SQL:
        assert compare.differences(rows, compare.duck_rows(duck, SQL[name])) == ""
    assert rows[1]


def test_comparison_can_fail(duck):
    one = compare.duck_rows(duck, "SELECT 1 AS a, 2.0::DOUBLE AS b")
    assert compare.differences(one, compare.duck_rows(duck, "SELECT 1 AS a, 2.5::DOUBLE AS b"))
    assert compare.differences(one, compare.duck_rows(duck, "SELECT 1 AS a, 2.0::DOUBLE AS c"))
    assert compare.differences(one, compare.duck_rows(duck, "SELECT 1 AS a, 2.0::DOUBLE AS b WHERE false"))

"""Every query with SQL against it, on the smallest tables."""

import compare
import pytest

from tauframe.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.queries())
    assert numbers == list(range(1, 14))
    assert set(catalog.sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.sql()))
def test_query_equals_sql(spark, duck, name):
    got = compare.spark_rows(catalog.queries()[name](spark, SF))
    assert compare.differences(got, compare.duck_rows(duck, catalog.sql()[name])) == ""
    assert got[1]

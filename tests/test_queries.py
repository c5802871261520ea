"""Every registered query of the engine against its SQL."""

import pytest

import __spark_entry__ as entry

from .oracle import SF, duck, same

QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = [n for n in QUERIES if n != "pipeline" and not n.startswith("op")]


@pytest.fixture(scope="module")
def con():
    with duck() as c:
        yield c


@pytest.mark.parametrize("name", [n for n in OWN if n in SQL])
def test_same_rows(spark, con, name):
    same(con, QUERIES[name](spark, SF), SQL[name])


@pytest.mark.parametrize("name", [n for n in OWN if n not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

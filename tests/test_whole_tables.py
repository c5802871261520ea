"""Queries that read all rows of their tables, by their rows."""

import __spark_entry__ as entry

from .oracle import SF, duck

QUERIES = entry.queries()


def one(sql):
    with duck() as con:
        return con.execute(sql).fetchone()[0]


def test_join_null_safe_reads_all_rows(spark):
    out = QUERIES["join_null_safe"](spark, SF).collect()
    nulls = one("SELECT (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) * (SELECT count(*) FROM supplier WHERE s_suppkey % 7 = 0)")
    assert [r.n for r in out if r.a is None and r.b is None] == [nulls] and len({r.a for r in out}) == len(out)


def test_sort_null_order_ranks_all_rows(spark):
    out = QUERIES["sort_null_order"](spark, SF).collect()
    n = one("SELECT count(*) FROM customer")
    assert [r.rn for r in out] == list(range(1, n + 1))
    nulls = sum(r.k is None for r in out)
    keys = [r.k for r in out[nulls:]]
    assert all(r.k is None for r in out[:nulls]) and keys and keys == sorted(keys, reverse=True)


def test_numeric_functions_rounds_ties_away_from_zero(spark):
    from decimal import ROUND_HALF_UP, Decimal

    with duck() as con:
        balances = dict(con.execute("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) FROM customer").fetchall())
    out = {r.c_custkey: r for r in QUERIES["numeric_functions"](spark, SF).collect()}
    assert set(out) == set(balances) and any(k % 10 == 5 for k in out)
    for k, b in balances.items():
        want = float(b.quantize(Decimal("0.1"), ROUND_HALF_UP)), float((b / 100).quantize(Decimal(1), ROUND_HALF_UP) * 100), (k + 5) // 10 * 10
        assert (out[k].r1, out[k].r2, out[k].ri) == want

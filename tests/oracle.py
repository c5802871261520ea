"""Comparing a registered query with its SQL as DuckDB runs it."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _cell(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return f"{0.0 if x == 0 else x:.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_cell, x)) + "]"
    return f"{type(x).__name__}:{x}"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(_cell(r[k]) for k in order) for r in values)


def same(con, df, sql):
    """Column names and rows, as multisets, of both sides."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = rows(names, got.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(names)
    assert len(have) == len(want), (len(have), len(want))
    odd = [(a, b) for a, b in zip(have, want) if a != b]
    assert not odd, odd[:3]

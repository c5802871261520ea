"""Queries whose tasks must stay small as their tables grow."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.operators import joins

QUERIES = entry.queries()


@pytest.mark.parametrize("broadcast_rows", [joins.CHUNKED_ROWS, 0])
def test_less_join_gives_each_pair_once(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(joins, "CHUNKED_ROWS", broadcast_rows)
    draw, odd = random.Random(3), [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0]
    for m, n in ((0, 5), (1, 1), (90, 70)):
        left = [(k, draw.choice([*odd, *map(float, range(-9, 9))])) for k in range(m)] * 2
        right = [(k, draw.choice([*odd, *map(float, range(-9, 9))])) for k in range(n)]
        a, b = spark.createDataFrame(left, "a int, low double"), spark.createDataFrame(right, "b int, high double")
        want = a.crossJoin(b).where("low < high").select("a", "b")
        got = joins.less_join(a, b, "low", "high", pairs_a_task=50, chunk_bits=2).select("a", "b")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_less_join_chunks_are_short_and_in_order(spark):
    draw = random.Random(5)
    values = [(k, float(draw.choice([7, draw.randrange(10_000)]))) for k in range(40_000)]
    chunks = joins._chunks(spark.createDataFrame(values, "b int, high double").repartition(3), "high", 8, len(values), "r")
    ends = sorted((r["__r_low"], r["__r_high"], r.n) for r in chunks.withColumn("n", F.size("__rs")).collect())
    assert sum(n for _, _, n in ends) == len(values) and max(n for _, _, n in ends) <= 256
    assert all(x[1] <= y[0] for x, y in itertools.pairwise(ends))


def test_join_nested_loop_deals_its_pairs_over_tasks(spark, tmp_path):
    bal = ((F.col("id") * 7919) % 1_100_000 / 100 - 1000).alias("s_acctbal")
    spark.range(0, 40_000, 1, 1).select(F.col("id").alias("s_suppkey"), bal).write.parquet(f"{tmp_path}/supplier.parquet")
    counts = [r.n for r in QUERIES["join_nested_loop"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    values = sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/supplier.parquet").select("s_acctbal").collect())
    want, k = 0, 0
    for high in (v - 9000 for v in values):
        while k < len(values) and values[k] < high:
            k += 1
        want += k
    assert sum(counts) == want and max(counts) < want / 4


def test_approximate_distinct_keeps_no_sketch_a_key(spark, tmp_path):
    key = F.when(F.col("id") % 10 != 0, F.col("id") % 20_000).alias("l_partkey")
    for name, n, want in (("many", 60_000, 18_000), ("nulls", 1, 0), ("none", 0, 0)):
        spark.range(0, n, 1, 2).select(key).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        out = QUERIES["approximate_distinct_within_bounds"](spark, f"{tmp_path}/{name}")
        assert [tuple(r) for r in out.collect()] == [(want, True)]
        aggregates = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "approx_count_distinct" in x]
        assert aggregates and all("keys=[]" in x for x in aggregates)

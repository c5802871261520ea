"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, tidy, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v).  Minima come from partial aggregates; the join back is one Spark can split.

    Both sides are dealt by u already, so a merge join costs no more than a
    broadcast would, and spares the driver from holding and sending tables in
    every round.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (two long columns): root is the component's smallest node.

    Each round is written to the shared folder; rounds end when the edges no
    longer change, after a number that grows with the logarithm of the longest
    chain.  No edges give no rows; loops and repeated edges are harmless.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = written(now, "edges")
    state = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == state or not sums[0]:
            break
        state = sums
        before, now = now, written(_stars(_stars(now, True), False), "stars")
        discard(before)
        tidy(edges.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

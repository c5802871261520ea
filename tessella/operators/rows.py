"""Sorting, limits, set operations and exchanges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_n(df: DataFrame, order: Sequence, n: int, *projected) -> DataFrame:
    """The first n rows in order, as a top-n on each partition and one over their results."""
    out = df.orderBy(*order).limit(n)
    return out.select(*projected) if projected else out


def expand(df: DataFrame, projections: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Each input row once through every projection."""
    rows = [F.struct(*(c.alias(n) for c, n in zip(p, names))) for p in projections]
    return df.select(F.inline(F.array(*rows)))


def by_hash(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def by_range(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartitionByRange(n, *keys)


def round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def single(df: DataFrame) -> DataFrame:
    """One partition: for results of a known small size only."""
    return df.coalesce(1)


def rebalanced(df: DataFrame, *keys: str) -> DataFrame:
    """Partitions of the advised size; large ones are split, so hot keys do no harm."""
    return df.hint("rebalance", *keys)


def compare(left: DataFrame, right: DataFrame, how: str, keep_duplicates: bool = False) -> DataFrame:
    """intersect or except, by set or (keep_duplicates) by multiset."""
    if how == "intersect":
        return left.intersectAll(right) if keep_duplicates else left.intersect(right)
    if how == "except":
        return left.exceptAll(right) if keep_duplicates else left.subtract(right)
    raise ValueError(how)

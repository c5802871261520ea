"""Grouped and global aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One aggregate over several key sets in a single pass (Expand below a hash aggregate)."""
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggregates)


def masked(aggregate: str, condition: str) -> Column:
    """An aggregate over the rows that meet a condition, as SQL's FILTER clause."""
    return F.expr(f"{aggregate} FILTER (WHERE {condition})")


def first_by(value: str, order: str, ignore_nulls: bool = False) -> Column:
    """first() with a defined order: the value of the row with the least order."""
    if ignore_nulls:
        return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return F.min_by(value, order)


def distinct_limit(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """n distinct rows of keys, the least ones so that the result is defined."""
    return df.select(*keys).distinct().orderBy(*keys).limit(n)


def single_row(df: DataFrame) -> DataFrame:
    """The only row of df, nulls if it has none; an error at run time if it has more."""
    names = df.columns
    packed = df.select(F.struct(*names).alias("r")).limit(2).agg(F.count("*").alias("n"), F.first("r").alias("r"))
    checked = packed.withColumn("ok", F.when(F.col("n") > 1, F.raise_error(F.lit("more than one row from a scalar subquery")).cast("boolean")).otherwise(F.lit(True)))
    return checked.where("ok").select(*(F.col(f"r.{c}").alias(c) for c in names))


def two_phase(df: DataFrame, key: str, salts: int, partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """For aggregates without partial forms over hot keys: by key and salt first, then by key."""
    salted = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    first = salted.groupBy(key, "__salt").agg(*(c.alias(n) for n, c in partial.items()))
    return first.groupBy(key).agg(*(c.alias(n) for n, c in final.items()))

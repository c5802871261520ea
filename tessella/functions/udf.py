"""User functions by name, as vectorised (Arrow batch) functions over pandas series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession, name: str, function, returns: str) -> None:
    """Registers function(series, ...) -> series; the last dotted part of name, lowered, is what SQL calls."""

    args = max(1, function.__code__.co_argcount)
    if args == 1:

        def one(a: pd.Series) -> pd.Series:
            return function(a)

        spark.udf.register(_short(name), F.pandas_udf(one, returns))
    elif args == 2:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return function(a, b)

        spark.udf.register(_short(name), F.pandas_udf(two, returns))
    else:
        raise ValueError("one or two arguments")


def _short(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower()


def call(name: str, *columns) -> Column:
    return F.call_function(_short(name), *columns)

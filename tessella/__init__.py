"""Analytics over Spark's DataFrames: operators, sources, materialized views and planning helpers."""

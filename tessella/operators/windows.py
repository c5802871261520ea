"""Window functions and ranked limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(aggregate: Column, partition: Sequence[str], order: Sequence, frame: tuple[int, int] | None = None, by_range: bool = False) -> Column:
    w = Window.partitionBy(*partition).orderBy(*order) if order else Window.partitionBy(*partition)
    if frame is not None:
        w = w.rangeBetween(*frame) if by_range else w.rowsBetween(*frame)
    return aggregate.over(w)


def group_top_n(df: DataFrame, partition: Sequence[str], order: Sequence, n: int, rank: str = "rank") -> DataFrame:
    """Rows with rank <= n in their group, with the rank.  Spark limits groups before the shuffle (WindowGroupLimit)."""
    function = {"rank": F.rank, "row_number": F.row_number, "dense_rank": F.dense_rank}[rank]
    return df.withColumn(rank, over(function(), partition, order)).where(F.col(rank) <= n)

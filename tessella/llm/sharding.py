"""Contiguous shards of near-equal bytes.

Rows are put in order by range partitioning, each partition gives one total,
and the running sum of those totals (one row a partition) turns the running
sum inside a partition into a global one.  Cutting the global sum at equal
targets gives contiguous shards whose sizes differ by a row at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import written


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row of docs.

    size is the UTF-8 length of the text plus 1; a null text counts as no
    bytes and has the checksum of the empty one.  The order is by id, then
    checksum and size; rows equal in all of these are interchangeable, so
    repeated rows get different slots.  Null ids come first.  slot numbers a
    shard's rows from 0 without gaps.  An empty table gives no rows; with
    fewer rows than shards some shards stay empty.

    Only ids and numbers are shuffled.  A salt as the last sort key lets range
    partitioning cut through any number of rows with one id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("crc"),
        F.pmod(F.monotonically_increasing_id(), F.lit(4096)).alias("salt"),
    )
    order = ["id", "crc", "size", "salt"]
    rows = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = (
        rows.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select(
            F.col("part").alias("p"),
            F.coalesce(F.sum("bytes").over(before), zero).alias("bytes_before"),
            F.coalesce(F.sum("n").over(before), zero).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("total"),
        )
    )  # one row a partition
    inside = Window.partitionBy("part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        rows.withColumns({"sum_in": F.sum("size").over(upto), "row_in": F.row_number().over(inside)})
        .join(F.broadcast(parts), F.col("part") == F.col("p"))
        .withColumn("start", F.col("bytes_before") + F.col("sum_in") - F.col("size"))
        .select(
            "id", "size", "crc",
            # a row belongs to the shard its middle byte falls into
            F.expr(f"cast(least({shards - 1}, cast((2 * start + size) as decimal(38,0)) * {shards} div (2 * total)) as int)").alias("shard"),
            (F.col("rows_before") + F.col("row_in") - 1).alias("at"),
        )
    )
    placed = written(placed, "shard-placed")
    firsts = placed.groupBy(F.col("shard").alias("s")).agg(F.min("at").alias("first"))  # one row a shard
    return placed.join(F.broadcast(firsts), F.col("shard") == F.col("s")).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - F.col("first")).alias("slot")
    )

"""Joins.  Spark chooses the strategy unless one is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HINTS = {"sort_merge": "merge", "shuffled_hash": "shuffle_hash", "nested_loop": "shuffle_replicate_nl"}
BROADCAST_LIMIT = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; unknown sizes are huge."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """df with a broadcast hint when its estimate is within limit, else df for a shuffled join."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def join(left: DataFrame, right: DataFrame, on, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """strategy: None, broadcast (only within the size limit), sort_merge, shuffled_hash or nested_loop; it applies to right."""
    if strategy == "broadcast":
        right = broadcast_checked(right)
    elif strategy is not None:
        right = right.hint(HINTS[strategy])
    return left.join(right, on, how)


def exists_flag(left: DataFrame, right: DataFrame, key: str, right_key: str, flag: str) -> DataFrame:
    """left with a boolean: whether right has the key (false for a null key).  Right is reduced to its keys first."""
    keys = right.select(F.col(right_key).alias("__key")).where("__key IS NOT NULL").distinct()
    return left.join(keys, F.col(key) == F.col("__key"), "left").withColumn(flag, F.col("__key").isNotNull()).drop("__key")


def not_in(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Rows whose key is not in right, with the SQL meaning of NOT IN: none if right has a null; null keys only against an empty right."""
    keys = right.select(F.col(right_key).alias("__key"))
    nulls = keys.agg(F.count("*").alias("__rows"), F.count_if(F.col("__key").isNull()).alias("__nulls"))
    kept = left.join(keys.where("__key IS NOT NULL").distinct(), F.col(key) == F.col("__key"), "left_anti").crossJoin(F.broadcast(nulls))
    return kept.where((F.col("__rows") == 0) | ((F.col("__nulls") == 0) & F.col(key).isNotNull())).drop("__rows", "__nulls")


#: Kinds of join that give each row of the left at most once a match, so that copies of the right change nothing.
SALTED = ("inner", "left", "leftouter", "left_outer", "semi", "leftsemi", "left_semi", "anti", "leftanti", "left_anti")


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys with at least this share of the rows: 1 / share of them at most."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("__n") >= F.lit(share) * F.col("__all")).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner", share: float = 0.01) -> DataFrame:
    """An equi-join whose hot keys on the left (a share of its rows or more) go to `salts` tasks each.

    Only the right's rows of hot keys are repeated.  A join that keeps rows of
    the right without a match would keep each of their copies: such kinds are
    refused.
    """
    if how not in SALTED:
        raise ValueError(f"{how}: rows of the right that match nothing would be repeated")
    hot = F.broadcast(hot_keys(left, key, share).withColumnRenamed(key, "__hot"))
    is_hot = F.col("__hot").isNotNull()
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    salted = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(is_hot, spread).otherwise(0)).drop("__hot")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


#: Right sides of more rows than this are not broadcast in chunks.
CHUNKED_ROWS = 1 << 20


def _chunks(df: DataFrame, value: str, size_bits: int, rows: int, side: str) -> DataFrame:
    """df in order of value as arrays of 2^size_bits rows at most, each with its id and its least and greatest value; null values go."""
    parts, order = max(1, rows >> 14), [value, *(c for c in df.columns if c != value)]
    dealt = df.where(F.col(value).isNotNull()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Ids count rows from 0 in each partition, whose number begins at bit 33.
    chunk = F.shiftright(F.monotonically_increasing_id(), size_bits).alias(f"__{side}")
    chunked = dealt.select(chunk, F.col(value).alias("__v"), F.struct(*df.columns).alias("__row")).repartition(parts, f"__{side}")
    return chunked.groupBy(f"__{side}").agg(F.collect_list("__row").alias(f"__{side}s"), F.min("__v").alias(f"__{side}_low"), F.max("__v").alias(f"__{side}_high"))


def less_join(left: DataFrame, right: DataFrame, low: str, high: str, pairs_a_task: int = 1 << 27, chunk_bits: int = 8) -> DataFrame:
    """All pairs of rows with low (a column of left) < high (of right); the sides share no column name.

    Both sides are sorted into chunks and only chunks whose ends can meet are
    opened, so that the work is the result's plus a strip along its border.
    Pairs of chunks are dealt over tasks in number as the pairs of rows, each
    with some pairs_a_task at most: the result may grow with the square of the
    input, a task does not.
    """
    m, n = left.count(), right.count()
    a, b = _chunks(left, low, chunk_bits, m, "l"), _chunks(right, high, chunk_bits, n, "r")
    cells = join(a, b, F.col("__l_low") < F.col("__r_high"), strategy="broadcast" if n <= CHUNKED_ROWS else "nested_loop")
    tasks = min(10_000, max(1, -(-m * n // pairs_a_task)))
    dealt = cells.select("__l", "__r", "__ls", "__rs").repartition(tasks, "__l", "__r")
    opened = dealt.select(F.explode("__ls").alias("__a"), "__rs").select("__a", F.explode("__rs").alias("__b"))
    return opened.where(F.col(f"__a.{low}") < F.col(f"__b.{high}")).select("__a.*", "__b.*")


def range_condition(value: Column, low: Column, high: Column) -> Column:
    return (value >= low) & (value < high)

"""Vector best-fit packing of documents into sequences.

A bin (sequence) has three capacities: tokens, documents and attention cost
(the sum of squared piece lengths).  Pieces go longest first; each goes into
the open bin that holds it under every constraint and scores best, by the
smallest weighted norm of what stays free or by the largest weighted
dot product of the piece with what is free.

Pieces of one length are interchangeable, so the plan is made over the counts
of each length (at most one number a token of capacity) and over groups of
equal bins.  One step fills as many bins of a group as the count allows and
splits the group in at most three; so the plan's size is bounded by the
capacity, whatever the number of documents: at most five placements for each
length and group.  The plan says which ranks of each length go to which bins,
and every piece finds its place from its rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import utf8_batches, written


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    score: str = "norm"  # or "dot"


def plan_bins(counts: dict[int, int], cap: Capacity) -> np.ndarray:
    """Placements as rows (length, first rank, first bin, pieces a bin, first offset).

    Ranks of a length are dealt in the order of the rows.  Raises ValueError
    where a single piece breaks a capacity.
    """
    limit = np.array([cap.tokens, cap.documents, cap.attention], dtype=np.float64)
    weights = np.asarray(cap.weights, dtype=np.float64)
    free = np.zeros((0, 3), np.int64)  # one row a group of equal bins
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    placements: list[tuple[int, int, int, int, int]] = []
    bins = 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        item = np.array([length, 1, length * length], dtype=np.int64)
        left, rank = counts[length], 0
        fits = np.flatnonzero((free >= item).all(axis=1))
        if cap.score == "dot":
            best = -((free[fits] / limit) * (item / limit) * weights).sum(axis=1)
        else:
            best = (weights * ((free[fits] - item) / limit) ** 2).sum(axis=1)
        new: list[tuple[np.ndarray, int, int]] = []

        def fill(room, at, n, left, rank):
            """Puts up to left pieces into n bins with that room; the rest of the bins come back as they were."""
            each = int((room // item).min())
            full = min(n, left // each)
            if full:
                placements.append((length, rank, at, each, cap.tokens - int(room[0])))
                new.append((room - each * item, at, full))
                left, rank = left - full * each, rank + full * each
            if left and full < n:
                placements.append((length, rank, at + full, left, cap.tokens - int(room[0])))
                new.append((room - left * item, at + full, 1))
                full, rank, left = full + 1, rank + left, 0
            return full, left, rank

        for g in fits[np.argsort(best, kind="stable")]:
            if not left:
                break
            full, left, rank = fill(free[g].copy(), int(first[g]), int(many[g]), left, rank)
            first[g] += full
            many[g] -= full
        if left:
            room = np.array([cap.tokens, cap.documents, cap.attention], dtype=np.int64)
            if (room < item).any():
                raise ValueError(f"a piece of {length} tokens breaks a capacity")
            each = int((room // item).min())
            full, left, rank = fill(room, bins, -(-left // each), left, rank)
            bins += full
        free = np.vstack([free, *(r for r, _, _ in new)]) if new else free
        first = np.append(first, [a for _, a, _ in new]).astype(np.int64)
        many = np.append(many, [n for _, _, n in new]).astype(np.int64)
        open_ = (many > 0) & (free > 0).all(axis=1)
        free, first, many = free[open_], first[open_], many[open_]
    return np.array(placements, dtype=np.int64).reshape(-1, 5)


def cut(n: int, tokens: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes what full pieces leave."""
    head = n % tokens or min(n, tokens)
    yield 0, head
    for start in range(head, n, tokens):
        yield start, tokens


def pieces(docs: DataFrame, tokens: int, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's ids, the id 0 after them; null text is empty."""
    out = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def tokenise(batches):
        from zlib import crc32

        from tessella.llm.tokens import encoder

        ids = encoder(tokenizer).ids
        for keys, texts in utf8_batches(batches, ["id", "text"]):
            rows: list[tuple] = []
            for key, text in zip(keys, texts):
                data = ids(text or "") + b"\0\0\0\0"
                for k, (start, n) in enumerate(cut(len(data) // 4, tokens)):
                    rows.append((key, k, start, n, crc32(data[4 * start : 4 * (start + n)])))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols[1:], out))], ["id", *out.names]
            )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(tokenise, "id long, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame,
    capacity: Capacity = Capacity(),
    tokenizer: str = "byte_bpe_50k.json",
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1024,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs.

    A document is its token ids and then id 0; a null or empty text is that
    one id.  Only documents over the capacity are cut, into full pieces with a
    shorter first one.  offset counts tokens from the start of the sequence;
    pieces of a sequence follow each other without gaps.  Rows with a repeated
    or null id are packed like any other.  An empty table gives no rows.

    Ranks come from counts per (bucket, length) with a row_number inside each:
    no task sees all pieces of a common length.
    """
    spark = docs.sparkSession
    items = pieces(docs, capacity.tokens, tokenizer, id_col, text_col)
    items = written(items.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")), "pieces")
    counted = items.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    by_length = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity.tokens rows
    plan = plan_bins(by_length, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "length").orderBy("id", "piece", "ids_crc32")
    ranked = (
        items.withColumn("row", F.row_number().over(inside))
        .join(starts, ["bucket", "length"])
        .select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row") - 1).alias("rank"))
    )
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    sent = spark.sparkContext.broadcast(plan[order])  # bounded by the capacity

    def place(batches):
        slots = sent.value
        keys = slots[:, 0] * (1 << 44) + slots[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            slot = slots[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1]
            at = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(slot[:, 2] + at // slot[:, 3]), pa.array(slot[:, 4] + at % slot[:, 3] * length)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    placed = ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)

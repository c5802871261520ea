"""Near copies by the Jaccard similarity of shingle sets: MinHash bands find candidates, the sets decide.

A pair at similarity 0.8 misses all 24 bands of 6 with a chance of 7 in
10,000, one at 0.85 with 3 in 1,000,000; pairs at 0.3, which shared passages
make by the million, meet in 2 of 100 cases.  Each candidate pair is verified
on the whole sets, so nothing below the similarity is linked.

Each list has a leader, drawn by hash, so that a document of a large group
meets different members in different lists.  First each document is compared
with one leader, the one it shares most bands with; what is linked goes, and
with it nearly all of a large group.  Of what is left, short lists are paired;
in long ones all members are compared with the leader.  Lists that stay long
(texts with a passage in common) are split by a further band, and again: pairs
of copies share others as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, semi, tidy, utf8_batches, written
from tessella.llm.components import connected_components

BANDS, PER_BAND = 24, 6
#: Longer lists are not paired: they are compared with a leader or split.
PAIRED_AT_MOST = 50


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the runs of so many words, A-Z lowered; a shorter text is one run, and no words give none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}
    return np.unique(np.fromiter((xxh64_intdigest(r, 42) for r in runs), np.uint64, len(runs)))


def _odd() -> np.ndarray:
    """A multiplier for each hash function: products of random 64-bit hashes with odd numbers are permutations of them."""
    return np.random.default_rng(7).integers(0, 1 << 63, BANDS * PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_ODD = _odd()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One number a band."""
    from xxhash import xxh64_intdigest

    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[None, at : at + 512] * _ODD[:, None]).min(axis=1))
    return np.array([xxh64_intdigest(least[k * PER_BAND : (k + 1) * PER_BAND].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def _lists(docs: DataFrame, id_col: str, text_col: str, name: str, of) -> DataFrame:
    def computed(batches):
        for keys, texts in utf8_batches(batches, ["id", "text"]):
            both = [(k, of(t)) for k, t in zip(keys, texts)]
            both = [(k, v.tolist()) for k, v in both if len(v)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in both], pa.int64()), pa.array([v for _, v in both], pa.list_(pa.int64()))], ["id", name])

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(computed, f"id long, {name} array<bigint>")


def _bands(text, shingle: int) -> np.ndarray:
    hashes = shingle_set(text, shingle)
    return band_keys(hashes) if len(hashes) else hashes


def _alike(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of at least this similarity, written.  Sets are made again for the documents of pairs only."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    view = lambda t: shingle_set(t, shingle).view(np.int64)
    sets = written(_lists(semi(docs, ids, id_col), id_col, text_col, "hashes", view), "shingle-sets")
    of_u, of_v = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"of_{c}")) for c in ("u", "v"))
    common = F.size(F.array_intersect("of_u", "of_v"))
    alike = common >= F.lit(similarity) * (F.size("of_u") + F.size("of_v") - common)
    out = written(pairs.join(of_u, "u").join(of_v, "v").where(alike).select("u", "v").distinct(), "near-links")
    discard(sets)
    return out


def _lists_of(keyed: DataFrame) -> DataFrame:
    """(id, band, last, n, leader) of keyed (id, band, last, ...) in lists of two or more."""
    lists = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("band", "id").alias("h"), "id")).alias("first"))
    return keyed.join(lists.where("n > 1"), "band").select("id", "band", "last", "n", F.col("first.id").alias("leader"))


def _split(rows: DataFrame, long_: DataFrame) -> DataFrame:
    """Long lists by each further band of their members."""
    more = long_.select("id", "band", "last").join(rows, "id").select("id", "band", "last", F.posexplode("bands").alias("at", "other")).where("at > last")
    return more.select("id", F.xxhash64("band", "other").alias("band"), F.col("at").alias("last"))


def _led(shared: DataFrame) -> DataFrame:
    return shared.where("id <> leader").select(F.greatest("id", "leader").alias("u"), F.least("id", "leader").alias("v"))


def without_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, paired_at_most: int = PAIRED_AT_MOST
) -> DataFrame:
    """The rows of docs without those linked, over pairs of at least this similarity, to a smaller id that stays.

    No two of the rows that stay are that similar, if they meet in a band
    whose list is short, or in several where lists are long.  Rows with a null id or without words stay.  Rows
    that share an id stay or go together.  Other columns may have any names
    and are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = written(_lists(docs, id_col, text_col, "bands", lambda t: _bands(t, shingle)), "bands")
    shared = written(_lists_of(rows.select("id", F.posexplode("bands").alias("last", "band"))), "bands-shared")
    removed: DataFrame | None = None
    checked: list[DataFrame] = []

    def compare(found: DataFrame) -> bool:
        """Verifies the pairs that are new; whether any documents go."""
        nonlocal removed
        found = found.distinct()
        for done in checked:
            found = found.join(done, ["u", "v"], "left_anti")
        pairs = written(found, "bands-pairs")
        links = _alike(docs, pairs, id_col, text_col, shingle, similarity)
        checked.append(pairs)
        going = written(connected_components(links).where("node <> root").select("node").distinct(), "near-gone")
        discard(links)
        tidy(spark)
        if going.isEmpty():
            return False
        removed = going if removed is None else removed.unionAll(going)
        return True

    def left(shared: DataFrame) -> DataFrame:
        """The lists without the documents that went."""
        if removed is None:
            return shared
        kept = shared.select("id", "band", "last").join(removed.toDF("__gone"), F.col("id") == F.col("__gone"), "left_anti")
        out = written(_lists_of(kept), "bands-left")
        discard(shared)
        return out

    def paired(now: DataFrame) -> DataFrame:
        """All pairs of short lists, and those with the leader of long ones."""
        a, b = (now.where(F.col("n") <= paired_at_most).select("band", F.col("id").alias(c)) for c in ("u", "v"))
        return a.join(b, "band").where("u > v").select("u", "v").unionAll(_led(now.where(F.col("n") > paired_at_most)))

    met = shared.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("n"))
    if compare(_led(met.groupBy("id").agg(F.max_by("leader", F.struct("n", F.xxhash64("id", "leader"))).alias("leader")))):
        shared = left(shared)
    if compare(paired(shared)):
        shared = left(shared)
    long_ = shared.where(F.col("n") > paired_at_most)
    if not long_.isEmpty():
        found, tables = None, []
        while not long_.isEmpty():  # ends with the last band at the latest
            now = written(_lists_of(_split(rows, long_)), "bands-split")
            tables.append(now)
            found = paired(now) if found is None else found.unionAll(paired(now))
            long_ = now.where(F.col("n") > paired_at_most)
        compare(found)
        discard(*tables)
    discard(rows, shared, *checked)
    if removed is None:
        return docs
    return docs.join(removed.toDF("__key"), docs[id_col] == F.col("__key"), "left_anti")

"""Near duplicates by SimHash and a byte-position inverted index.

Fingerprints of 64 bits that differ in at most two bits share at least six of
their eight positional bytes.  An index on single bytes would have posting
lists of a 256th of all fingerprints, so a posting here is five positional
bytes: eleven choices of the three bytes left out cover every pair of bytes in
which two fingerprints may differ, so that each linked pair meets in at least
one posting list.  For each pair that meets, the shared positional bytes are
tallied; pairs with the guaranteed six are verified by the bits that differ.

A posting list of many fingerprints (a large group of near copies) is not
paired.  Its members agree in 40 bits, and two of them differ in at most two
of the other 24 if and only if some value lies within one bit of both.  So
each member is dealt to itself and its 24 neighbours, and those dealt to one
value, 25 at most and all linked to each other, are joined as a star.  The
components are the same as those of all links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import semi, tidy, utf8_batches, written
from tessella.llm.components import connected_components

BYTES, LINK_BITS = 8, 2
GUARANTEED = BYTES - LINK_BITS
#: Triples of byte positions such that each pair of positions is in one of them.
LEFT_OUT = ((0, 1, 2), (0, 3, 4), (0, 5, 6), (0, 1, 7), (1, 3, 5), (1, 4, 6), (2, 3, 6), (2, 4, 5), (3, 4, 7), (5, 6, 7), (2, 3, 7))
#: Lists above this size are joined as stars: from here on that makes fewer rows than pairing does.
PAIRED_AT_MOST = 50


def _covers() -> bool:
    return all(any({*pair} <= {*t} for t in LEFT_OUT) for pair in combinations(range(BYTES), LINK_BITS))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(words: list[bytes], shingle: int) -> int:
    """Of one document's words, as an unsigned number; no words give 0."""
    from xxhash import xxh64_digest

    if not words:
        return 0
    if len(words) <= shingle:
        digests = xxh64_digest(b" ".join(words), 42)
        n = 1
    else:
        text = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends)]
        digests = b"".join([xxh64_digest(text[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])])
        n = len(words) - shingle + 1
    data = np.frombuffer(digests, np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(data[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of each row: words of the text with A-Z lowered, shingles with repeats; null counts as no words."""

    def hashed(batches):
        for keys, texts in utf8_batches(batches, ["id", "text"]):
            # bytes.lower() and bytes.split() know A-Z and the six ASCII separators only
            fps = [_signed(simhash((t or "").encode().lower().split(), shingle)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps, pa.int64())], ["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(hashed, "id long, fp long")


def _byte(c: Column, k: int) -> Column:
    return F.shiftrightunsigned(c, 8 * (7 - k)).bitwiseAND(F.lit(255))


def links(fps: DataFrame, paired_at_most: int = PAIRED_AT_MOST) -> DataFrame:
    """Edges (u, v) between different fingerprints (column fp, each once) whose components are those of all links."""
    masks = [(k, sum(255 << 8 * (7 - b) for b in range(BYTES) if b not in out)) for k, out in enumerate(LEFT_OUT)]
    keys = [F.struct(F.lit(k).alias("list"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bytes")) for k, m in masks]
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.list", "key.bytes")
    by = ["list", "bytes"]
    lengths = postings.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    shared = written(postings.join(lengths, by), "postings")

    short = shared.where(F.col("n") <= paired_at_most)
    a, b = (short.select(*by, F.col("fp").alias(c)) for c in ("u", "v"))
    tally = sum((_byte(F.col("u"), k) == _byte(F.col("v"), k)).cast("int") for k in range(BYTES))
    pairs = a.join(b, by).where(F.col("u") > F.col("v")).where(tally >= GUARANTEED)
    pairs = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= LINK_BITS).select("u", "v")

    free = [F.lit(_signed(1 << 8 * (7 - b) + k)) for out in LEFT_OUT for b in out for k in range(8)]
    flips = F.get(F.array(*(F.array(*free[24 * k : 24 * k + 24]) for k in range(len(LEFT_OUT)))), F.col("list"))
    near = F.concat(F.array("fp"), F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit)))
    dealt = shared.where(F.col("n") > paired_at_most).select(*by, "fp", F.explode(near).alias("value"))
    stars = dealt.groupBy(*by, "value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 25 at most
    stars = stars.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v")
    return pairs.unionAll(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs.

    fingerprint is 16 lowercase hex digits.  component_id is the smallest id
    that is reachable over links of at most two differing bits, itself
    included.  Documents without words (null, empty, separators only) have the
    fingerprint zero, which links like any other.  Repeated rows and ids are
    linked like other equal texts; null ids belong to components but never
    name one, so a component of null ids only has none.  An empty table gives
    no rows.

    Links are sought between different fingerprints; copies are joined to
    their fingerprint's row and never paired.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    fps = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(fps.select("fp")))
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    tidy(docs.sparkSession)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of docs whose id names their component, their columns untouched; rows with a null id stay, and so do all rows that share a kept id."""
    kept = near_duplicates(docs, id_col, text_col, shingle).where(F.col(id_col).eqNullSafe(F.col("component_id")) | F.col(id_col).isNull())
    return semi(docs, kept.select(id_col), id_col)


assert _covers()

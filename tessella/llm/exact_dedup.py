"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is the polynomial of its normalised bytes at a fixed
point, modulo two primes below 2**31.  Chunks are hashed by themselves (a dot
product with a table of powers) and combine by length-shifted arithmetic,
h(ab) = h(a) * x**len(b) + h(b), so a huge document needs no more memory than a
chunk, and chunks may be hashed anywhere in any order.  Texts with equal
fingerprints and lengths are then compared, chunk by chunk, with one leader of
their group; what differs from its leader forms the next class, with a leader
of its own, until nothing differs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, discard, semi, utf8_batches, written

PRIMES = (2147483647, 2147483629)
POINTS = (1299709321, 1878230267)
CHUNK = 1 << 16
#: Least and most words of 64 bits in the filter of copies, which is broadcast; between them it has 16 bits a copy.
WORDS, MOST_WORDS = 1 << 17, 1 << 20
#: Groups of two or more such parts of all rows are dealt to a key for each part before they are joined.
PARTS = 1000
_DELETED = b" \t\n\x0b\x0c\r"


class Fingerprint:
    """(h1, h2, length) of byte strings; combine() is associative with EMPTY as its identity."""

    EMPTY = (0, 0, 0)

    def __init__(self, chunk: int = CHUNK):
        self.chunk = chunk
        self._powers = []
        for p, x in zip(PRIMES, POINTS):
            table = np.ones(chunk, np.uint64)
            have = 1
            while have < chunk:  # doubling: x**(have+k) = x**have * x**k
                more = min(have, chunk - have)
                table[have : have + more] = table[:more] * np.uint64(pow(x, have, p)) % np.uint64(p)
                have += more
            self._powers.append(table[::-1].copy())

    def of_chunk(self, data: bytes) -> tuple[int, int, int]:
        """Of at most chunk bytes.  Each byte counts as its value plus 1, so leading zero bytes count."""
        n = len(data)
        if not n:
            return self.EMPTY
        values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        return (*(int(values @ t[-n:]) % p for p, t in zip(PRIMES, self._powers)), n)

    @staticmethod
    def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
        h = ((ha * pow(x, b[2], p) + hb) % p for ha, hb, x, p in zip(a, b, POINTS, PRIMES))
        return (*h, a[2] + b[2])

    def of(self, data: bytes) -> tuple[int, int, int]:
        view = memoryview(data)
        return reduce(self.combine, (self.of_chunk(view[k : k + self.chunk]) for k in range(0, len(data), self.chunk)), self.EMPTY)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, n_chars, h, length, text_sha256) of each row; h joins both hashes, length is in normalised bytes."""

    def hashed(batches):
        from hashlib import sha256

        of = Fingerprint(chunk).of
        for keys, texts in utf8_batches(batches, ["id", "text"]):
            rows = []
            for text in texts:
                text = text or ""
                data = text.encode().translate(None, _DELETED)
                h1, h2, n = of(data)
                rows.append((len(text), h1 << 31 | h2, n, sha256(data).hexdigest()))
            chars, h, n, sha = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(chars, pa.int64()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(sha)],
                ["id", "n_chars", "h", "length", "text_sha256"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(hashed, "id long, n_chars long, h long, length long, text_sha256 string")


def _words_for(ids: int) -> int:
    """A power of two."""
    return min(MOST_WORDS, max(WORDS, 1 << max(0, ids - 1).bit_length() >> 2))


def _filter_of(ids: DataFrame, words: int) -> DataFrame:
    """(word, bits) of a Bloom filter with one hash over the ids: so many rows at most, however many ids."""
    hashed = ids.select(F.xxhash64("id").alias("x"))
    bit = F.expr("shiftleft(1L, cast(x & 63 as int))")
    return hashed.select(_word(F.col("x"), words).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _word(x, words: int):
    return F.pmod(F.shiftrightunsigned(x, 6), F.lit(words)).cast("int")


def _with_group(rows: DataFrame, groups: DataFrame, key: list[str], total: int) -> DataFrame:
    """rows with the columns of their group, of groups (key, n, ...), which is a written table of one row a group.

    A group of n rows gets a key for each PARTS-th of all rows in it, PARTS in
    all at most, so that no task meets a whole large group.  The large groups
    are PARTS / 2 at most, and only those are broadcast.
    """
    split = groups.withColumn("salts", F.greatest(F.lit(1), F.floor(F.col("n") * PARTS / max(1, total)).cast("int")))
    large = split.where("salts > 1").select(*key, F.col("salts").alias("dealt"))
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("dealt")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(large), key, "left").withColumn("salt", salt).drop("dealt")
    return dealt.join(split.select("*", _salts()).hint("merge"), [*key, "salt"]).drop("salt")


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")


def _row(sha) -> Column:
    """What tells rows apart: the id, null or not, and the text."""
    return F.concat_ws(":", F.col("id").cast("string"), sha)


def _differing(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """The rows (row) of members (row, id, h, length, leader, salts) whose normalised text differs from their leader's.

    A filter of bounded size keeps most texts without copies from being
    shuffled; what it lets through by chance, which is more where copies are
    beyond its bound, the join drops.  Merge joins move the same share of the
    input at every size.
    """
    words = _words_for(members.count())
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"[{SPACE}]+", "")
    n = F.ceil(F.length("norm") / chunk).cast("int")
    part = F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
        lambda k: F.struct(k.alias("k"), F.col("norm").substr(k * chunk + 1, F.lit(chunk)).alias("chunk")),
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias(text_col)).withColumn("x", F.xxhash64("id"))
    maybe = rows.join(F.broadcast(_filter_of(members, words)), _word(F.col("x"), words) == F.col("word"))  # MOST_WORDS rows of 12 bytes at most
    maybe = maybe.where(F.expr("(shiftrightunsigned(bits, cast(x & 63 as int)) & 1) = 1")).select("id", text.alias("norm"))
    maybe = maybe.select(_row(F.sha2("norm", 256)).alias("row"), "norm")
    chunks = maybe.join(members.drop("id").hint("merge"), "row").select("row", "h", "length", "leader", "salts", F.inline(part))
    chunks = written(chunks, "chunks")
    at = ["h", "length", "leader", "k"]
    leaders = chunks.where("row = leader").groupBy(*at, "salts").agg(F.first("chunk").alias("of_leader"))  # once, though its row may be repeated
    leaders = leaders.select(*at, "of_leader", _salts())
    others = chunks.where("row <> leader").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int"))
    both = others.join(leaders.hint("merge"), [*at, "salt"], "left")
    differing = both.where(~F.col("chunk").eqNullSafe(F.col("of_leader"))).select("row").distinct()
    differing = written(differing, "differing")
    discard(chunks)
    return differing


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of docs, dropped ones too.

    Texts are equal when they are identical without space, tab and line
    breaks; null equals empty.  Of equal texts the row with the most code
    points stays, then the smallest id.  Rows that share an id are copies if
    their texts are equal: all of them carry the verdict of that id, and
    group_size counts them; different texts under one id are rows of different
    groups.  A null id is never preferred over another; a group of null ids
    only has no keep_id and keeps its rows.  An empty table gives no rows.

    Groups are counted by partial aggregates, and rows join their group's
    result and their leader's text by salted keys: a hot group's rows meet in
    no single task.
    """
    rows = written(fingerprints(docs, id_col, text_col, chunk), "fingerprints")
    key = ["h", "length"]
    total = rows.count()
    each = rows.withColumn("row", _row(F.col("text_sha256")))

    def led(rest: DataFrame) -> DataFrame:
        """Groups of two rows or more that differ in id or text, and the leader of each."""
        out = rest.groupBy(*key).agg(F.count("*").alias("n"), F.min("row").alias("leader"), F.max("row").alias("last"))
        return written(out.where("leader <> last").drop("last"), "leaders")

    members = _with_group(each, led(each), key, total).select("row", "id", *key, "leader", "salts")
    members = written(members.distinct(), "members")
    classes = rows.withColumn("class", F.lit(0))
    level = 0
    while True:
        odd = _differing(docs, members, id_col, text_col, chunk)
        if odd.isEmpty():
            break
        # a collision of fingerprints: the odd ones form a class with a leader of its own
        level += 1
        mark = odd.select(F.col("row").alias("odd"))
        classes = classes.join(mark, _row(F.col("text_sha256")) == F.col("odd"), "left")
        classes = classes.withColumn("class", F.when(F.col("odd").isNotNull(), level).otherwise(F.col("class"))).drop("odd")
        rest = written(members.join(odd, "row").select("row", "id", *key), "odd")
        members = written(_with_group(rest, led(rest), key, total).select(*members.columns), "members")
    key = [*key, "class"]
    best = F.struct((-F.col("n_chars")).alias("chars"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    groups = classes.groupBy(*key).agg(F.count("*").alias("n"), F.min(best).alias("best"))
    groups = written(groups.select(*key, "n", F.col("best.id").alias("keep_id")), "groups")
    return _with_group(classes, groups, key, total).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates keeps, their columns untouched.

    Rows that share an id stay or go together: one of them that is kept keeps
    all, copies under that id too.
    """
    return semi(docs, exact_duplicates(docs, id_col, text_col).where("kept").select(id_col), id_col)

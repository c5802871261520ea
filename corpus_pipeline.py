"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact_dedup, mixing, near_text, packing, quality_model, simhash
from tessella.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents whose probability of the best grade (good and clean) is under 3/4 go."""
    return quality_model.accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts one stays."""
    return exact_dedup.without_duplicates(docs)


#: What counts as a near copy: the Jaccard similarity of sets of five-word shingles.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near copies stays, the smallest id.

    SimHash fingerprints of five-word shingles join what differs in at most
    two bits.  At a similarity of 0.8 two fingerprints differ in some ten of
    64 bits, where an index on bytes guarantees no match; the operator's
    bands of least shingle hashes find those pairs, and each is verified on
    whole sets of shingles.
    """
    left = simhash.one_of_each(docs, shingle=NEAR_SHINGLE)
    return near_text.without_near_copies(written(left, "near-fingerprints"), shingle=NEAR_SHINGLE, similarity=NEAR_SIMILARITY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mix takes it, a row for each copy, shard after shard in their order."""
    return mixing.mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of all rows, packed into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", sequences)]

#: Model weights, SimHash and token ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

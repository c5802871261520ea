import random

import pytest

#: Extra columns whose names the operators use inside.
CLASH = {"id": 7, "h": "x", "size": 1, "bucket": 2, "fp": 3, "row": 4, "n": 5, "kept": False, "score": 0.5, "shard": 9, "key": "k", "part": 1, "norm": "z", "x": 0, "grade": 1, "__key": 5}


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "thing", "word", "stone"]) + r.choice(["", "ing", "ed", "ly", "s"]) + r.choice(["", "", ".", ","]) + r.choice(["", "er"]) for _ in range(n))


def rows() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and blank texts, copies, near copies, ties, and a very long text."""
    out = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n\x0b\x0c\r ", "en", None), (4, "\x00", "en", "b"), (5, "Word", "de", "b"), (6, "two  words", "de", "b")]
    out += [(10 + k, prose(k, 40 + 7 * k), ("en", "de")[k % 2], "abc"[k % 3]) for k in range(20)]
    out += [(40 + k, prose(3, 61), "en", "c") for k in range(5)]  # copies of 13
    out += [(50, " " + prose(3, 61).replace(" ", "  "), "en", "c"), (51, prose(3, 61).upper(), "en", "c")]
    out += [(60 + k, prose(100, 300) + f" tail{k}", "en", "a") for k in range(8)]  # near copies
    out += [(70, prose(200, 30_000), "en", "a"), (71, prose(300, 5) + " 文字 é😀 <|endoftext|> <|im_end|>", "fr", "z"), (72, "# * $ %\n" * 30, "en", "z")]
    return out


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """The same with repeated rows, a null id and extra columns."""
    from pyspark.sql import functions as F

    again = next(r for r in rows() if r[0] == 13)
    more = [*rows(), again, again, (None, prose(5, 75), "en", None), (None, None, None, None)]
    df = spark.createDataFrame(more, SCHEMA).repartition(3)
    return df.select("*", *(F.lit(v).alias(k) for k, v in CLASH.items()))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

"""The pipeline on the smallest tables, each stage against a plain version of its decision."""

import importlib.util
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def linked_to_smaller(sets):
    """Ids that a chain of pairs at 0.8 or more links to a smaller id."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i for i in sets if root(i) != i}


def test_each_stage(spark):
    import corpus_pipeline
    from tessella.llm import mixing
    from tessella.llm.common import table, written

    from .test_operators import brute_components, brute_copies, slow_simhash

    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())

    first = written(stages["quality"](spark, docs, SF), "t-quality")
    assert first.columns == docs.columns and 0 < first.count() <= docs.count()
    second = written(stages["exact_dedup"](spark, first, SF), "t-exact")
    pairs = [(r.doc_id, r.text) for r in first.collect()]
    assert second.columns == docs.columns and ids(second) == Counter({i for i, w in brute_copies(pairs).items() if w[0] == i})
    third = written(stages["near_dedup"](spark, second, SF), "t-near")
    left = {r.doc_id: r.text for r in second.collect()}
    of_fps = brute_components({i: slow_simhash(t, 5) for i, t in left.items()})
    left = {i: shingles(t) for i, t in left.items() if of_fps[i] == i}
    assert third.columns == docs.columns and ids(third) == Counter(set(left) - linked_to_smaller(left))
    fourth = written(stages["mixing"](spark, third, SF), "t-mix")
    want = Counter({r.doc_id: r.copies for r in mixing.mix(third).collect() if r.copies})
    assert fourth.columns == docs.columns and ids(fourth) == want
    last = stages["packing"](spark, fourth, SF).collect()
    assert Counter(r.doc_id for r in last if r.piece == 0) == want
    assert corpus_pipeline.run(spark, SF).count() == len(last)


def test_near_dedup_drops_near_copies_of_five_words(spark):
    """Edits of one text, at five-word similarities on both sides of 0.8, singly and as a large group."""
    import random

    import corpus_pipeline
    from tessella.llm import near_text

    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]

    def edited(words, at):
        return [w if k not in at else f"z{rng.randrange(10**9)}" for k, w in enumerate(words)]

    texts, gone = {}, set()
    for k in range(12):
        base = fresh(120)
        texts[10 * k] = base
        texts[10 * k + 1] = edited(base, {30, 90})  # 106 of 126 runs: 0.84
        texts[10 * k + 2] = edited(base, {20, 60, 100})  # 101 of 131: 0.77
        gone.add(10 * k + 1)
    crowd = fresh(300)
    texts |= {1000 + k: edited(crowd, {5 + 4 * k}) for k in range(70)}
    gone |= {1000 + k for k in range(1, 70)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()] + [(None, "a b c"), (-5, " "), (-4, None)], "doc_id long, text string")
    kept = lambda df: {r.doc_id for r in df.collect()}
    want = {*texts, None, -5, -4} - gone
    assert kept(near_text.without_near_copies(docs)) == want
    assert kept(near_text.without_near_copies(docs, paired_at_most=1)) == want  # all lists are long: led, then split
    assert kept(corpus_pipeline.near(spark, docs, SF)) == want - {-4}  # without words: equal fingerprints


def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty and repeated rows, an empty table, and columns with names that stages use themselves."""
    import corpus_pipeline
    from tessella.llm.common import table, written

    good = table(spark, SF, "documents").limit(12).collect()
    text = "\n".join(r.text or "" for r in good)
    odd = [(None, text, "en", "a", 1), (None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, " \t", None, "a", 2), (3, None, "de", "b", None)]
    odd += [(10 + k, r.text, r.lang, None if k % 3 else r.source, r.n_chars) for k, r in enumerate(good)] + [(10, good[0].text, "fr", "a", 9), (40, text * 40, None, "z", 3)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("id", "fp", "size", "block", "n", "h", "hash", "score"):
        docs = docs.withColumn(c, docs["n_chars"])
    for rows in (docs, docs.where("false")):
        now, count = rows, None
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, now, SF), f"odd-{name}")
            if name != "packing":
                assert out.columns == docs.columns
                before, after = Counter(now.select("doc_id").collect()), Counter(out.select("doc_id").collect())
                assert set(after) <= set(before) and (name == "mixing" or all(after[k] <= before[k] for k in after))
                now = out
            count = out.count()
        assert (count > 0) == (rows is docs)

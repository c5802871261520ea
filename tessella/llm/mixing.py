"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words.  Each source gets a target.  A hash deals its documents to
blocks of about equal size, and the target says how many of its blocks the mix
draws: each in every whole epoch, and some in the last one.  Which output
shard draws how many blocks of which source is settled by a tree: each node
splits its exact quotas between the two halves of its shards as a
multivariate-hypergeometric draw, so that quotas add up at every level.  Shard
after shard then draws its quota from the blocks left in the source's epoch,
by a permutation of its own, so the blocks are disjoint, and which of them the
mix takes depends on the tree.  A shard orders its documents by another hash.

The last epoch is cut at the target: its blocks stand in the order drawn,
documents inside a block in hash order, and what ends before the cut is taken.
The gap that the document on the cut leaves is filled by first fit over those
after it, in the same order, and in the end by the one that fits best.

Only DataFrame expressions touch rows; the driver sees one row a block, whose
number the parameters bound: shards * blocks_per_shard, and one more a source.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, literal_rows, tidy, written

#: More sources are an error: their targets and blocks would not fit into a bounded plan.
MAX_SOURCES = 10_000


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight; none above most times its size, the excess going to the others by weight."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    open_ = [k for k in range(len(sizes))]
    left = total
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / weight > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / weight
            break
        for k in over:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return out


def split_quotas(quotas: Sequence[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts; columns add up to quotas and rows differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        n = int(have.sum())
        share = n * (mid - lo) // (hi - lo)
        # numpy draws exact counts below 1e9 in all; larger nodes are thinned by whole multiples first
        scale = max(1, -(-n // 900_000_000))
        whole = have // scale if scale > 1 else have
        draw = min(int(whole.sum()), share // scale)
        left = rng.multivariate_hypergeometric(whole, draw, method="marginals") * scale
        short = share - int(left.sum())
        for k in np.argsort(-(have - left), kind="stable"):
            if short <= 0:
                break
            more = min(short, int(have[k] - left[k]))
            left[k] += more
            short -= more
        node(lo, mid, left)
        node(mid, hi, have - left)

    if len(quotas):
        node(0, shards, np.asarray(quotas, np.int64))
    return out


RUNS = "array<struct<after:bigint,upto:bigint,longest:double>>"


def in_runs() -> Column:
    """Whether a document (start, size) is in one of the runs that fill() gives."""
    return F.coalesce(F.exists("runs", lambda r: (F.col("start") > r["after"]) & (F.col("start") <= r["upto"]) & (F.col("size") <= r["longest"])), F.lit(False))


def fill(later: DataFrame, gaps: dict[tuple, float]) -> DataFrame:
    """(of, left, runs) for each source: first fit over its later documents by start, without a bound on their number.

    later has (source, bucket, size, start), with buckets in the order of start; gaps are the words to fill, by source.
    A run takes each document after one start and up to another that is no longer than the gap at its beginning.  It
    ends before the first of these that does not fit any more; the next run goes on from there with what is left.  So
    each run shortens the length that can be taken, in hash order by about half, and no run passes over what fits.
    """
    spark = later.sparkSession
    end = (1 << 63) - 1
    state = {k: {"after": -1, "left": float(gap), "runs": []} for k, gap in gaps.items()}
    active = {k for k, s in state.items() if s["left"] >= 1}
    key = lambda r: (r["source"]["none"], r["source"]["name"])
    while active:
        now = [{"none": k[0], "name": k[1], "after": state[k]["after"], "left": state[k]["left"]} for k in sorted(active)]
        at = literal_rows(spark, now, "none boolean, name string, after long, left double").select(F.struct("none", "name").alias("source"), "after", "left")
        fits = later.join(F.broadcast(at), "source").where((F.col("start") > F.col("after")) & (F.col("size") <= F.col("left")))
        sums = fits.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        ordered = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("words").over(ordered))  # one row a bucket
        crossing = F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))
        found = {key(r): r for r in sums.groupBy("source").agg(F.sum("words").alias("words"), F.min(crossing).alias("cross")).collect()}
        crossed = [
            {"none": k[0], "name": k[1], "bucket": r["cross"]["bucket"], "before": r["cross"]["before"], "after": state[k]["after"], "left": state[k]["left"]}
            for k, r in sorted(found.items()) if r["cross"] is not None
        ]
        stops = {}
        if crossed:
            in_ = literal_rows(spark, crossed, "none boolean, name string, bucket int, before long, after long, left double")
            in_ = in_.select(F.struct("none", "name").alias("source"), "bucket", "before", "after", "left")
            one = later.join(F.broadcast(in_), ["source", "bucket"]).where((F.col("start") > F.col("after")) & (F.col("size") <= F.col("left")))
            inside = Window.partitionBy("source", "bucket").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            one = one.withColumn("upto", F.col("before") + F.sum("size").over(inside)).where(F.col("upto") > F.col("left"))
            stop = F.min(F.struct("start", (F.col("upto") - F.col("size")).alias("taken")))
            stops = {key(r): r["stop"] for r in one.groupBy("source").agg(stop.alias("stop")).collect()}
        for k in list(active):
            s = state[k]
            if k not in found:  # nothing that fits is left
                active.discard(k)
                continue
            stop = stops.get(k)
            upto, taken = (stop["start"] - 1, stop["taken"]) if stop else (end, found[k]["words"])
            s["runs"].append({"after": s["after"], "upto": upto, "longest": s["left"]})
            s["after"], s["left"] = upto + 1 if stop else end, s["left"] - taken
            if not stop or s["left"] < 1:
                active.discard(k)
    rows = [{"none": k[0], "name": k[1], "left": s["left"], "runs": s["runs"]} for k, s in sorted(state.items())]
    return literal_rows(spark, rows, f"none boolean, name string, left double, runs {RUNS}").select(F.struct("none", "name").alias("of"), "left", "runs")


def draw(blocks: int, epochs: int, quotas: Sequence[int], rng: np.random.Generator) -> tuple[list[int], np.ndarray]:
    """One source's draws: (ranks, shards).

    quotas are blocks by shard, in all at least epochs * blocks and fewer than
    one epoch more.  Shard by shard draws from what is left of the epoch by a
    permutation of its own.  ranks[b] is block b's place in the last epoch, in
    the order drawn, the undrawn ones after them; shards[b, e] is the shard
    that draws b in epoch e, or -1.
    """
    shards = np.full((blocks, epochs + 1), -1, np.int64)
    order: list[int] = []
    epoch, left = 0, np.arange(blocks)
    for shard, need in enumerate(quotas):
        while need > 0:
            left = left[rng.permutation(len(left))]
            now, left = left[:need], left[need:]
            shards[now, epoch] = shard
            need -= len(now)
            if epoch == epochs:
                order.extend(now.tolist())
            if not len(left) and epoch < epochs:
                epoch, left = epoch + 1, np.arange(blocks)
    order.extend((left if epoch == epochs else np.arange(blocks)).tolist())
    ranks = [0] * blocks
    for rank, block in enumerate(order):
        ranks[block] = rank
    return ranks, shards


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    most: int = 3,
    shards: int = 8,
    blocks_per_shard: int = 256,
    seed: int = 20250,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row a document: (id, size, source_size, target, copies, taken, places).

    size counts the words of the text (null or wordless: 0).  Sources go by
    code point, null last, and weigh weights in turn, repeating.  copies says
    how often the mix takes the whole document, at most `most` times, and
    places has (epoch, shard, block, position) for each copy; ordering a shard
    by position is its local shuffle.  Each source's taken words are within
    half of one document of its target, where documents that fit are left.  A
    source without words has target 0 and takes nothing.  Rows with a repeated
    id are documents of their own; equal rows are interchangeable.  Other
    columns may have any names and are not read.  An empty table gives no
    rows.  The same rows and seed give the same mix, however they are
    partitioned.  More than MAX_SOURCES sources raise ValueError.

    A source may hold most rows: only sums by (source, block) and running sums
    inside a block are taken, and a source has as many blocks as its share.
    """
    spark = docs.sparkSession
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit(""))))
    base = docs.select(
        F.col(id_col).alias("id"),
        F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        hashed.alias("h"),
    )
    base = written(base, "mix-base")
    sources = base.groupBy("source").agg(F.sum("size").alias("words")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: map them to fewer before mixing")
    sizes = [r["words"] for r in sources]
    goals = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], most)
    unit = max(1, sum(sizes) // (shards * blocks_per_shard))  # words a block
    blocks = [max(1, -(-words // unit)) for words in sizes]
    epochs = [int(goal // words) if words else 0 for goal, words in zip(goals, sizes)]
    rests = [goal - e * words for goal, words, e in zip(goals, sizes, epochs)]
    quotas = [e * b + (min(b, int(-(-rest * b // words))) if words and rest > 0 and e < most else 0) for e, b, rest, words in zip(epochs, blocks, rests, sizes)]
    rng = np.random.default_rng(seed)
    dealt = split_quotas(quotas, shards, rng)

    # each document's block: a row a source first, since the number of blocks is the source's
    named = [{"none": r["source"]["none"], "name": r["source"]["name"]} for r in sources]
    per_source = [n | {"source_size": w, "target": g, "epochs": e, "blocks": b} for n, w, g, e, b in zip(named, sizes, goals, epochs, blocks)]
    per_source = literal_rows(spark, per_source, "none boolean, name string, source_size long, target double, epochs int, blocks int")
    per_source = per_source.select(F.struct("none", "name").alias("source"), "source_size", "target", "epochs", "blocks")
    in_block = F.pmod(F.shiftrightunsigned("h", 20), F.col("blocks")).cast("int")
    base = base.join(F.broadcast(per_source), "source").withColumn("block", in_block)  # at most MAX_SOURCES rows are sent
    sums = {(r["source"]["none"], r["source"]["name"], r["block"]): r["words"] for r in base.groupBy("source", "block").agg(F.sum("size").alias("words")).collect()}
    per_block = []
    for k, n in enumerate(named):
        ranks, drawn = draw(blocks[k], epochs[k], [int(q) for q in dealt[:, k]], rng)
        before = 0
        for rank, b in enumerate(sorted(range(blocks[k]), key=ranks.__getitem__)):
            per_block.append(n | {"block": b, "bucket": rank, "before": before, "shards": drawn[b].tolist()})
            before += sums.get((n["none"], n["name"], b), 0)
    # as a table, so that plans do not carry all of it
    per_block = written(literal_rows(spark, per_block, "none boolean, name string, block int, bucket int, before long, shards array<int>"), "mix-blocks")
    per_block = per_block.select(F.struct("none", "name").alias("source"), "block", "bucket", "before", "shards")
    inside = Window.partitionBy("source", "block").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        base.withColumn("upto", F.sum("size").over(inside))
        .join(F.broadcast(per_block), ["source", "block"])  # at most shards * blocks_per_shard + MAX_SOURCES rows are sent
        .withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    )
    placed = written(placed, "mix-placed")
    # A document's start names it within its source, since only documents with words are taken.
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    words = (F.col("size") > 0) & (F.col("epochs") < most)
    early = words & (F.col("start") + F.col("size") <= rest)
    gaps = placed.where(words).groupBy("source").agg((F.first(rest) - F.coalesce(F.max(F.when(early, F.col("start") + F.col("size"))), F.lit(0))).alias("gap"))
    later = placed.where(words & ~early).select("source", "bucket", "size", "h", "start")
    filled = fill(later, {(r["source"]["none"], r["source"]["name"]): r["gap"] for r in gaps.collect()})
    tidy(spark)
    off = F.abs(F.col("size") - F.col("left"))
    free = later.join(F.broadcast(filled), F.col("source") == F.col("of")).where((off < F.col("left")) & ~in_runs())
    fit = free.groupBy("source").agg(F.min(F.struct(off.alias("off"), "size", "h", "start")).alias("fit"))
    chosen = filled.join(fit, F.col("of") == F.col("source"), "left").select("of", "runs", F.col("fit.start").alias("best"))
    placed = placed.join(F.broadcast(chosen), F.col("source") == F.col("of"), "left")  # a row a source at most
    chosen_later = in_runs() | (F.col("start") == F.col("best"))
    extra = F.when(early | (words & F.coalesce(chosen_later, F.lit(False))), 1).otherwise(0)
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + extra).otherwise(0).cast("int"))

    def place(epoch):
        drawn = F.get("shards", epoch)
        # a filling document of a block that no shard drew goes to any shard
        shard = F.when(drawn >= 0, drawn).otherwise(F.pmod(F.col("h"), F.lit(shards))).cast("int")
        return F.struct(epoch.cast("int").alias("epoch"), shard.alias("shard"), F.col("block").alias("block"), F.xxhash64(F.lit(seed + 1), F.col("h"), epoch).alias("position"))

    places = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), place)).otherwise(F.array().cast("array<struct<epoch:int,shard:int,block:int,position:bigint>>"))
    return placed.select(
        F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), places.alias("places")
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 8, **options) -> DataFrame:
    """The rows of docs as the mix takes them, a row for each copy, with its columns and no others, in the order of the shards.

    Partitions go by shard, several a shard and in its order, and rows inside
    them by position: written files, by their names, are the shuffled shards
    one after the other.  A document that the mix leaves out gives no row.
    Rows that share an id are taken together: each as often as the most taken
    of them.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, shards=shards, **options)
    keys = taken.where("copies > 0").groupBy(id_col).agg(F.max(F.struct("copies", "places")).alias("most")).select(F.col(id_col).alias("__key"), F.explode("most.places").alias("__place"))
    joined = docs.join(keys, docs[id_col].eqNullSafe(keys["__key"]))
    names = [docs[c] for c in docs.columns]
    slices = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    place = F.col("__place")
    slice_ = F.least(F.lit(slices - 1), F.floor((place["position"] / F.lit(2.0**64) + 0.5) * slices))
    dealt = joined.select(*names, "__place").repartitionById(shards * slices, (place["shard"] * slices + slice_).cast("int"))
    ordered = dealt.sortWithinPartitions(place["position"], place["epoch"])
    return ordered.drop("__place")

"""Quality rules with risk-controlled thresholds.

The rules compare counts of a text with cutoffs.  Some are fixed (the base
rules); the others are chosen on labelled documents so that in each stratum
(language) all of them together reject good documents at a rate of at most
`risk`, with confidence 1 - delta over all strata.

Each labelled good document counts once.  A part of them, dealt by a hash of
the id, settles a path for each stratum: from all rules off, step by step that
rule is tightened to its next cutoff that costs the fewest good documents of
this part.  On the other part the path is walked: at each step the exact
(Clopper-Pearson) upper bound on the rate of good documents that any rule
rejects is computed, and the walk ends before the first step whose bound
exceeds the risk.  The path does not depend on the documents it is tested on,
so its steps need no correction (fixed-sequence testing); each walk has the
level delta / strata (Bonferroni).  A walk that ends at once leaves the rules
off in that stratum, as do strata with no labels.

Counting is one pass of JVM expressions over whole texts; labels meet counts
in a join of ids and numbers; the driver sees how many good documents of a
stratum pass how many cutoffs of each rule, at most a row for each combination.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import exp, lgamma, log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD, let, literal_rows, written

WINDOW = 8
#: More strata with labels are an error: their cutoffs would not fit into a bounded broadcast.
MAX_STRATA = 10_000


def _tail(n: int, k: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    term = n * log1p(-p)
    total, lead = 0.0, term
    terms = []
    for i in range(k + 1):
        terms.append(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p))
        lead = max(lead, terms[-1])
    total = sum(exp(t - lead) for t in terms)
    return min(1.0, total * exp(lead))


def within_risk(n: int, k: int, risk: float, level: float) -> bool:
    """Whether the exact upper bound at that level on a rate with k cases in n is at most risk."""
    return n > 0 and k <= risk * n and _tail(n, k, risk) <= level


@dataclass(frozen=True)
class Risk:
    risk: float = 0.02
    delta: float = 0.05
    #: share of the labelled good documents that the paths are settled on
    tuned: float = 0.3
    seed: int = 3
    #: rule -> cutoffs, mildest first; a text is rejected where the rule's value is above the cutoff
    cutoffs: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbols_per_word": (2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
            "dup_lines_share": (0.9, 0.7, 0.5, 0.4, 0.3),
            "repeat_share": (0.29, 0.28, 0.26, 0.24, 0.22, 0.2),
            "capitals_share": (0.9, 0.7, 0.5, 0.4),
            "bars_per_word": (1.0, 0.8, 0.6, 0.4, 0.3, 0.25, 0.2),
            "chars_per_word": (100.0, 50.0, 30.0, 20.0, 15.0),
        }
    )


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur at least twice in the array."""

    def pairs(hashes: Column, step: int) -> Column:
        """Hashes of twice the width, from two that stand step apart."""
        n = F.size(hashes) - step
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + step)))).otherwise(
            F.array().cast("array<bigint>")
        )

    def covered(windows: Column) -> Column:
        by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            starts = F.transform(s, lambda x, k: F.when((F.when(k > 0, same(x, k - 1)).otherwise(False)) | same(x, k + 1), x["i"]))
            return F.array_sort(F.filter(starts, lambda i: i.isNotNull()))

        def length(at: Column) -> Column:
            steps = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        distinct = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(distinct, F.lit(0).cast("long")).otherwise(let(by_hash, lambda s: let(twice(s), length)))

    one = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        let(one, lambda h1: let(pairs(h1, 1), lambda h2: let(pairs(h2, 2), lambda h4: let(pairs(h4, 4), covered))))
    )


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """(id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_bars, n_lines) of whole texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), stratum.alias("stratum"), text.alias("text"))
    measured = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    line_counts = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    return rows.select(
        "id",
        "stratum",
        measured.alias("m"),
        line_counts.alias("l"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"\|")).cast("long").alias("n_bars"),
    ).select("id", "stratum", "m.*", "l.*", "n_symbols", "n_capitals", "n_bars")


def _signals() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "capitals_share": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "bars_per_word": F.col("n_bars") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


Passed = dict[tuple[int, ...], int]


def path(passed: Passed, steps: tuple[int, ...]) -> list[int]:
    """Rules in the order of tightening.  passed: documents by the number of cutoffs of each rule that they pass; steps: cutoffs a rule has.

    Ties go to the rule that has the smallest share of its steps behind it, then to the first.
    """
    at = [0] * len(steps)
    out: list[int] = []
    left = dict(passed)
    while len(out) < sum(steps):
        cost = {r: sum(n for p, n in left.items() if p[r] <= at[r]) for r in range(len(steps)) if at[r] < steps[r]}
        r = min(cost, key=lambda r: (cost[r], at[r] / steps[r], r))
        left = {p: n for p, n in left.items() if p[r] > at[r]}
        at[r] += 1
        out.append(r)
    return out


def certified(tune: Passed, test: Passed, steps: tuple[int, ...], risk: float, level: float) -> list[int]:
    """How many cutoffs of each rule are on, after the longest walk along the path with a bound within the risk at each step."""
    n = sum(test.values())
    at = [0] * len(steps)
    for r in path(tune, steps):
        on = [a + (k == r) for k, a in enumerate(at)]
        rejected = sum(m for p, m in test.items() if any(x < y for x, y in zip(p, on)))
        if not within_risk(n, rejected, risk, level):
            break
        at = on
    return at


def choose_cutoffs(measured: DataFrame, labels: DataFrame, control: Risk, id_col: str, label_col: str) -> dict[str, dict[str, float]]:
    """stratum -> rule -> cutoff, of the strata and rules that have one.

    Good documents are those labelled 1 that pass the base rules.  Several
    labels of one document count once, as the worst of them, and so do several
    rows of one id in a stratum, rejected where any of them is; null labels
    and ids count as none.
    """
    labels = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label")).where("label = 1").select("id")
    held = measured.join(good, "id").where(~base_failed())
    signals = _signals()
    # cutoffs go down, so what passes the k-th passes those before it
    passes = [F.min(sum((signals[rule] <= cutoff).cast("int") for cutoff in cutoffs)).alias(rule) for rule, cutoffs in control.cutoffs.items()]
    once = held.groupBy("id", "stratum").agg(*passes)
    tuning = (F.pmod(F.xxhash64(F.lit(control.seed), "id"), F.lit(1000)) < int(1000 * control.tuned)).alias("tuning")
    rules = list(control.cutoffs)
    rows = once.groupBy("stratum", tuning, *rules).agg(F.count("*").alias("n")).collect()
    strata = sorted({r["stratum"] for r in rows})
    if len(strata) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata: choose a coarser column")
    steps = tuple(len(c) for c in control.cutoffs.values())
    parts: dict[tuple[str, bool], Passed] = {}
    for r in rows:
        parts.setdefault((r["stratum"], r["tuning"]), {})[tuple(r[rule] for rule in rules)] = r["n"]
    chosen: dict[str, dict[str, float]] = {}
    for s in strata:
        on = certified(parts.get((s, True), {}), parts.get((s, False), {}), steps, control.risk, control.delta / len(strata))
        if any(on):
            chosen[s] = {rule: control.cutoffs[rule][k - 1] for rule, k in zip(rules, on) if k}
    return chosen


def apply_rules(
    docs: DataFrame, labels: DataFrame, control: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", label_col: str = "quality"
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, failed_rules) for each row of docs.

    A null text has no words and fails the base rules, as do empty texts.  A
    null stratum is the stratum ''.  A cutoff rejects values above it, so ties
    are kept.  Without labels no cutoff is certified and the base rules decide
    alone.  Repeated rows are judged each; an empty table gives no rows.  Other
    columns may have any names and are not read.  More than MAX_STRATA strata
    with labels raise ValueError.
    """
    spark = docs.sparkSession
    measured = written(counts(docs, id_col, text_col, stratum_col), "counts")
    chosen = choose_cutoffs(measured, labels, control, id_col, label_col)
    table = literal_rows(spark, [{"of": s, "cutoffs": c} for s, c in chosen.items()], "of string, cutoffs map<string,double>")
    signals = _signals()
    tests = F.array(*(F.when(signals[rule] > F.try_element_at("cutoffs", F.lit(rule)), F.lit(rule)) for rule in control.cutoffs))
    failed = F.filter(tests, lambda r: r.isNotNull())
    return (
        measured.join(F.broadcast(table), F.col("stratum") == F.col("of"), "left")  # at most MAX_STRATA rows are sent
        .withColumns({"base_failed": base_failed(), "failed_rules": failed})
        .select(
            F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "stratum", "failed_rules",
        )
    )

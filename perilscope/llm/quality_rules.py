"""Quality rules with risk-controlled cutoffs.

Every text is measured (words, symbols, repeated lines, repeated word
triples). A fixed base rule rejects very short and mostly repeated texts.
On top, each rule ``measure >= cutoff`` gets its cutoff per stratum from the
labelled rows: walking a fixed grid from the most lenient cutoff down, a
cutoff is certified while the hypothesis "this rule rejects more than
``alpha`` of the stratum's good documents" is refuted by the exact binomial
tail at level ``delta / (strata x rules)``. Walking the grid in a fixed order
and stopping at the first failure needs no further correction inside a grid;
strata and rules are corrected by Bonferroni. So with probability
``1 - delta`` no certified rule rejects more than ``alpha`` of the good
documents of any stratum, and since ``alpha`` is ``STRATUM_ALPHA`` split over
the rules, the rules together reject at most ``STRATUM_ALPHA`` of them. Of the certified cutoffs the one that rejects most
labelled bad documents net of ``GOOD_WEIGHT`` times the good ones is used
(ties: the most lenient); a rule without a useful certified cutoff stays off.

Defined results: null text reads as empty (no words, ``base_failed``); a null
or unlabelled stratum value is a stratum of its own; a label row with null
quality is ignored; equal rows and equal labels of one document are one draw;
repeated documents are measured and returned each; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import textkernel as K

STRATUM_ALPHA = 0.06  # largest share of a stratum's good documents that may be rejected
DELTA = 0.05          # chance that any certificate is wrong
GOOD_WEIGHT = 5
MIN_WORDS = 50
# Grid of each rule in thousandths, from lenient to strict.
GRID = [900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100, 75, 50, 30, 20]
# Rule name -> (numerator, denominator) of the measure.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
}
ALPHA = STRATUM_ALPHA / len(RULES)    # each rule's part of it (union bound)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _measure(s: K.Slice) -> list[np.ndarray]:
    data, off = s.data, s.offsets
    rows = len(off) - 1
    w = K.words_of(data, off)
    n_words = np.diff(w.first)
    ink = ~K._SPACE[data]
    chars = K.per_row(ink & ((data & 0xC0) != 0x80), off)
    symbols = K.per_row(_SYMBOL[data], off)
    # Lines with a word, equal to an earlier one of the same row.
    start, end, own, h = K.lines_of(data, off)
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ink, out=c[1:])
    worded = c[end] > c[start]
    lh, lo = h[worded], own[worded]
    o = np.lexsort((lh, lo))
    dup = (lh[o][1:] == lh[o][:-1]) & (lo[o][1:] == lo[o][:-1])
    dups = np.bincount(lo[o][1:][dup], minlength=rows)
    n_lines = np.bincount(lo, minlength=rows)
    # Words inside word triples found twice or more in the text.
    g, at = K.ngrams(w, 3)
    twice = at[K.repeated(K.mix(g + w.row[at].astype(np.uint64)
                                * np.uint64(0x9E3779B97F4A7C15)))]
    hit = np.zeros(len(w.start), bool)
    for j in range(3):
        hit[twice + j] = True
    repeats = np.bincount(w.row[hit], minlength=rows)
    return [n_words, chars, symbols, dups, repeats, n_lines]


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row plus :data:`MEASURES` (long)."""
    own = text in keep          # the text travels once
    src = docs.select(*keep) if own else docs.select(*keep, F.col(text).alias("__text"))
    column = text if own else "__text"
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes),
                        *(f"{m} bigint" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in K.slices(b, column):
                cols = [s.batch.column(i) for i in range(len(keep))]
                cols += [pa.array(m.astype(np.int64)) for m in _measure(s)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *MEASURES])

    return src.mapInArrow(run, schema)


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def _level(rule: str) -> Column:
    """The measure in thousandths, rounded down (0 without words)."""
    num, den = RULES[rule]
    return F.coalesce(F.try_divide(F.col(num) * 1000, F.col(den)), F.lit(0.0)).cast("bigint")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly term by term.

    Terms follow t(i+1) = t(i) * (n-i)/(i+1) * p/(1-p) in logarithms, so no
    term under- or overflows; the sum runs over at most k+1 terms and only
    while k/n <= p, where the tail can be small.
    """
    odds, log_q = math.log(p / (1 - p)), math.log1p(-p)
    start = F.struct((n * F.lit(log_q)).alias("t"), F.exp(n * F.lit(log_q)).alias("s"))

    def step(acc, i):
        t = acc["t"] + F.log((n - i) / (i + 1.0)) + F.lit(odds)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k - 1), start, step,
                        lambda acc: acc["s"])
    return F.when(k > n * F.lit(p), F.lit(1.0)).when(k == 0, F.exp(n * F.lit(log_q))
                                                     ).otherwise(total)


def fit_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang",
                alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs: one row per (stratum, rule), in thousandths.

    Labelled rows are counted per (stratum, rule, level) first - at most
    strata x rules x grid rows - and everything after works on that table.
    """
    good = labels.where(F.col("quality").isNotNull()).select("doc_id", "quality")
    # Repeated rows of a labelled document are one draw of the binomial.
    numbers = sorted({c for pair in RULES.values() for c in pair})
    rows = (measured.where(~base_failed()).join(good, "doc_id")
            .select("doc_id", stratum, "quality", *numbers).distinct()
            .select(F.col(stratum).alias("stratum"), "quality",
                    F.explode(F.array(*[F.struct(F.lit(r).alias("rule"),
                                                 _level(r).alias("level"))
                                        for r in RULES])).alias("x"))
            .select("stratum", "quality", "x.rule", "x.level"))
    grid = F.array(*[F.lit(g).cast("bigint") for g in GRID])
    # A level falls into the most lenient cutoff that it reaches.
    step = F.size(F.filter(grid, lambda g: g > F.col("level")))
    counts = (rows.withColumn("step", step)
              .groupBy("stratum", "rule", "step")
              .agg(F.count_if(F.col("quality") == 1).alias("good"),
                   F.count_if(F.col("quality") == 0).alias("bad")))
    counts = stage(counts, "quality-counts")
    strata = counts.select("stratum").distinct().count()
    per_rule = (counts.groupBy("stratum", "rule")
                .agg(F.sum("good").alias("n"),
                     F.collect_list(F.struct("step", "good", "bad")).alias("cells")))
    def upto(field, g):
        return F.aggregate(F.col("cells"), F.lit(0).cast("bigint"),
                           lambda a, c: a + F.when(c["step"] <= g, c[field]).otherwise(0))
    steps = (per_rule
             .select("stratum", "rule", "n",
                     F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("g"),
                     "cells")
             .select("stratum", "rule", "n", "g", upto("good", F.col("g")).alias("k"),
                     upto("bad", F.col("g")).alias("bad")))
    level = delta / (max(strata, 1) * len(RULES))
    tested = (steps.withColumn("p", binomial_tail(F.col("k"), F.col("n"), alpha))
              .withColumn("ok", F.col("p") <= F.lit(level)))
    # Fixed sequence: only the steps before the first failure are certified.
    first_fail = (tested.groupBy("stratum", "rule")
                  .agg(F.min(F.when(~F.col("ok"), F.col("g"))).alias("fail"),
                       F.collect_list(F.struct("g", "k", "bad")).alias("steps")))
    gain = lambda s: s["bad"] - s["k"] * GOOD_WEIGHT
    best = F.aggregate(
        F.filter(F.array_sort("steps"),
                 lambda s: F.col("fail").isNull() | (s["g"] < F.col("fail"))),
        F.struct(F.lit(0).cast("bigint").alias("gain"), F.lit(-1).alias("g")),
        lambda a, s: F.when(gain(s) > a["gain"],
                            F.struct(gain(s).alias("gain"), s["g"].alias("g"))).otherwise(a),
        lambda a: a["g"])
    return (first_fail.withColumn("g", best).where(F.col("g") >= 0)
            .select("stratum", "rule",
                    F.element_at(grid, F.col("g") + 1).alias("cutoff")))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``base_failed`` and ``kept`` to every measured row."""
    per = (cutoffs.groupBy(F.col("stratum").alias("__s"))
           .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff")))
                .alias("__cut")))
    joined = measured.join(per, F.col(stratum).eqNullSafe(F.col("__s")), "left")
    fires = F.lit(False)
    for r in RULES:
        fires = fires | F.coalesce(_level(r) >= F.col("__cut")[r], F.lit(False))
    return (joined.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~fires)
            .drop("__s", "__cut"))


def quality_rules(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None,
                  stratum: str = "lang") -> DataFrame:
    """Measure every document, fit the cutoffs on the labelled ones, judge all."""
    cols = list(dict.fromkeys([*(keep or ["doc_id"]), "doc_id", stratum]))
    measured = stage(measure(docs, cols), "quality-measures")
    return judge(measured, fit_cutoffs(measured, labels, stratum), stratum)

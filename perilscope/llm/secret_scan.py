"""Secret scan with a randomness test battery, with DataFrame functions only.

Three fixed patterns give the base spans. Other long tokens go through a
battery of tests; each asks how likely the token would be if it were text or
structured data (the null hypothesis), for the encoding inferred from its
characters (hex, base32, base62, base64; it must mix letters and digits):

* uniformity: the chi-squared statistic against a uniform alphabet, through
  the number of equal character pairs it is a function of; text has at least
  ``max(2/A, 0.066)`` of its pairs equal, random characters 1/A;
* runs: the number of changes between digits, lower and upper case letters
  and marks; text changes at no more than ``TEXT_CHANGES`` of its places;
* serial correlation of neighbours; structured strings (counters, patterns)
  have at least ``SERIAL``;
* words: the share of the letters and digits that stand in word-like runs (three
  lower case letters or more with a vowel, with or without a capital before
  them); paths, identifiers and names of versions have at least ``WORDED`` of
  them there, random characters about a fifth. A run of four is one observation.
  Tokens without lower case letters are not asked (base32 has long runs of
  capitals), nor is hex, whose letters hardly make words.

A secret must refute all of them, so the largest p-value counts. False
discoveries are controlled by Benjamini-Hochberg within each length class
(short tokens carry less evidence and must not ride on long ones), on
p-values rounded up to a fixed grid, so a class needs one bounded histogram.

Spans are code points, end exclusive. Defined results: null text reads as
empty; overlapping spans of different kinds are all listed; a token that
touches a base span is not tested; repeated rows are returned each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

# Fixed patterns: kind -> (pattern, quick test, group that has a least length, that length).
ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
BASE = {
    "assign": (ASSIGN, 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
}
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}"
KINDS = [*BASE, "random"]

LENGTHS = [32, 48, 96]      # length classes: <32, <48, <96, longer
FALSE_DISCOVERY = 0.05
TEXT_CHANGES = 0.15
SERIAL = 0.7
WORDED = 0.8
WORD_RUN = 4
GRID = 4                    # p-values are kept as floor(-GRID * ln p)
TOP_BIN = 400
BLOCK = 256


def _starts(gaps: Column, sizes: Column) -> Column:
    """Start of every match from the lengths of the gaps before them and their own.

    Running sums in two levels, so that m matches cost about m * BLOCK steps.
    """
    n = F.size(sizes)
    step = F.transform(F.arrays_zip(gaps.alias("g"), sizes.alias("m")),
                       lambda x: x["g"] + F.coalesce(x["m"], F.lit(0)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(step, b * BLOCK + 1, F.lit(BLOCK)))
    empty = F.array().cast("array<int>")

    def running(a: Column) -> Column:
        """Sums before each element."""
        zero = F.struct(F.lit(0).alias("s"), empty.alias("out"))
        return F.aggregate(a, zero, lambda acc, x: F.struct(
            (acc["s"] + x).alias("s"), F.array_append(acc["out"], acc["s"]).alias("out")),
            lambda acc: acc["out"])

    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    before = running(F.transform(blocks, total))
    inner = F.transform(blocks, running)
    start = F.flatten(F.zip_with(inner, before, lambda xs, b: F.transform(xs, lambda x: x + b)))
    # A match starts after its own gap.
    return F.zip_with(F.slice(start, 1, n), F.slice(gaps, 1, n), lambda s, g: s + g)


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of all matches whose ``group`` has ``least`` characters."""
    rx = F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    checked = F.transform(F.regexp_extract_all(text, rx, F.lit(group)), F.length)
    sizes = F.transform(found, F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    every = F.zip_with(_starts(gaps, sizes), F.arrays_zip(sizes.alias("m"), checked.alias("c")),
                       lambda s, x: F.struct(s.alias("start"), F.lit(kind).alias("kind"),
                                             (s + x["m"]).alias("end"), x["c"].alias("c")))
    kept = F.transform(F.filter(every, lambda x: x["c"] >= least),
                       lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"),
                                          x["end"].alias("end")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(_SPAN))


def _normal_tail(z: Column) -> Column:
    """P(N(0,1) <= z) by the error function series of Abramowitz and Stegun."""
    x = F.abs(z) / math.sqrt(2)
    t = F.lit(1.0) / (x * 0.3275911 + 1)
    poly = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + c) * t
    upper = poly * F.exp(-x * x) / 2
    return F.greatest(F.when(z < 0, upper).otherwise(1 - upper), F.lit(1e-40))


def alphabet(token: Column) -> Column:
    """Size of the inferred alphabet; null where letters and digits do not mix."""
    bare = F.regexp_replace(token, "=+$", "")
    mixed = bare.rlike("[0-9]") & bare.rlike("[A-Za-z]")
    return F.when(mixed, F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16)
                  .when(bare.rlike("^[A-Z2-7]+$"), 32)
                  .when(bare.rlike("^[A-Za-z0-9]+$"), 62).otherwise(64))


WORD = "[A-Z]?(?=[a-z]*[aeiouy])[a-z]{3,}"


def battery(token: Column) -> Column:
    """The largest p-value of the tests (see the module's text)."""
    bare = F.regexp_replace(token, "=+$", "")
    n = F.length(bare).cast("double")
    chars = F.split(bare, "")
    counts = F.transform(F.array_distinct(chars),
                         lambda c: (F.length(bare) - F.length(F.replace(bare, c, F.lit(""))))
                         .cast("double"))
    equal = F.aggregate(counts, F.lit(0.0), lambda a, o: a + o * (o - 1) / 2)
    expected = n * (n - 1) / 2 * F.greatest(2.0 / alphabet(token), F.lit(0.066))
    uniform = _normal_tail((equal + 0.5 - expected) / F.sqrt(expected))
    changes = F.length(F.regexp_replace(
        bare, "[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+", "x")).cast("double") - 1
    mean = (n - 1) * TEXT_CHANGES
    runs = _normal_tail((mean + 0.5 - changes) / F.sqrt(mean * (1 - TEXT_CHANGES)))
    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    average = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
    sums = F.aggregate(codes, F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("c"),
                                       F.lit(0.0).alias("last")),
                       lambda a, x: F.struct(
                           (a["v"] + (x - average) * (x - average)).alias("v"),
                           (a["c"] + (x - average) * a["last"]).alias("c"),
                           (x - average).alias("last")))
    r = F.least(F.abs(F.coalesce(F.try_divide(sums["c"], sums["v"]), F.lit(1.0))),
                F.lit(0.999999))
    serial = _normal_tail((F.atanh(r) - math.atanh(SERIAL)) * F.sqrt(n - 3))
    # Marks separate words and belong to neither side.
    marks = F.regexp_replace(bare, "[^A-Za-z0-9]+", "")
    m = F.greatest(F.length(marks).cast("double"), F.lit(1.0))
    rest = F.length(F.regexp_replace(F.regexp_replace(
        bare, WORD, ""), "[^A-Za-z0-9]+", "")).cast("double")
    spread = math.sqrt(WORDED * (1 - WORDED) * WORD_RUN)
    words = _normal_tail((1 - rest / m - WORDED) * F.sqrt(m) / spread)
    asked = bare.rlike("[a-z]") & ~alphabet(token).eqNullSafe(16)
    return F.greatest(uniform, runs, serial, F.when(asked, words).otherwise(F.lit(0.0)))


def _length_class(n: Column) -> Column:
    return sum([(n >= x).cast("int") for x in LENGTHS[1:]], (n >= LENGTHS[0]).cast("int"))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``base`` spans and ``tokens``: tested tokens with their span,
    length class and p-value bin."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*[spans(t, p, k, g, least)
                                   for k, (p, g, least) in enumerate(BASE.values())]))
    df = docs.select(*keep, base.alias("base"),
                     F.when(t.rlike(TOKEN), F.zip_with(
                         spans(t, TOKEN, KINDS.index("random"), 0, 24),
                         F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)),
                         lambda s, w: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                               w.alias("word")))).alias("words"))
    free = F.filter(F.col("words"), lambda w: alphabet(w["word"]).isNotNull() & ~F.exists(
        F.col("base"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    bin_ = lambda w: F.least(F.floor(F.log(battery(w["word"])) * -GRID),
                             F.lit(TOP_BIN)).cast("int")
    tested = F.transform(free, lambda w: F.struct(
        w["start"].alias("start"), w["end"].alias("end"),
        _length_class(F.length(w["word"])).alias("class"), bin_(w).alias("bin")))
    return df.withColumn("tokens", F.coalesce(tested, F.array().cast(
        "array<struct<start:int,end:int,class:int,bin:int>>"))).drop("words")


def discoveries(scanned: DataFrame, q: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Least p-value bin that counts as a discovery, per length class.

    At most classes x bins counts reach the driver.
    """
    counts = (scanned.select(F.explode("tokens").alias("t"))
              .groupBy("t.class", "t.bin").count().collect())
    out = {}
    for c in {r["class"] for r in counts}:
        own = {r["bin"]: r["count"] for r in counts if r["class"] == c}
        total, seen = sum(own.values()), 0
        for b in sorted(own, reverse=True):
            seen += own[b]
            if math.exp(-b / GRID) <= q * seen / total:
                out[c] = b
    return out


def all_spans(least_bin: dict[int, int]) -> Column:
    """Base spans and discovered ones, sorted by start, then kind."""
    cut = F.lit(None).cast("int")
    found = F.filter(F.col("tokens"), lambda t: F.coalesce(t["bin"] >= sum(
        [F.when(t["class"] == c, F.lit(b)).otherwise(F.lit(0)) for c, b in least_bin.items()],
        F.when(t["class"].isin(list(least_bin)), F.lit(0)).otherwise(cut)), F.lit(False)))
    return F.array_sort(F.concat(F.col("base"), F.transform(found, lambda t: F.struct(
        t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"),
        t["end"].alias("end")))))


def render(span_list: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(span_list, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``base`` and ``spans`` (arrays of start, kind, end)."""
    scanned = stage(scan(docs, keep, text), "secret-spans")
    return scanned.withColumn("spans", all_spans(discoveries(scanned))).drop("tokens")


def redact(text: Column, span_list: Column, mask: str = "[SECRET]") -> Column:
    """Replace every span (overlapping ones together) by ``mask``."""
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    done = F.aggregate(
        span_list, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit(mask)).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                            acc["out"].alias("out"))))
    return F.when(F.size(span_list) == 0, text).otherwise(
        F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))

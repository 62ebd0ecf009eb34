"""Benchmark decontamination by SimHash windows, with DataFrame functions only.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.
A document window has the size of an item (in words) and may start anywhere.
Similarity 0.8 with an item takes at least 0.8 of the item's word 5-grams, so
windows are cut at every start where so many of the window's 5-grams are ones
of items of that size, in any order; no other window can match. Windows with
equal words are one *content*.

Contents and items get a 64-bit SimHash of their words. Fingerprints are cut
into ``RADIUS + 1`` blocks; two fingerprints within ``RADIUS`` bits agree in
at least one block, so joining on (size, block number, block value) finds
every pair within the radius. A changed run at the start or end of an item
can move a fingerprint further (about 10% of the words may differ, 9 bits on
average, deviation 2.8), so pairs are also found in an exact way: a window of
similarity ``THRESHOLD`` misses at most a fifth of the item's 5-grams and so
has one of the item's rarest fifth and one more. Each pair that either finds
is then compared exactly: the Jaccard similarity of the two bags of 5-grams,
sum of minimum counts over sum of maximum counts, at or above ``THRESHOLD``.

Defined results: null texts and items, and items of fewer than 5 words, match
nothing; a window is clipped at the ends of its document; repeated documents
are reported each, repeated items once per item_id; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 11
# Benchmarks of up to this many 5-grams go to every task (about 32 MB); larger
# ones are joined by a shuffle of the documents' 5-grams.
BROADCAST_SHINGLES = 1_000_000

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    """Hash of every word, in order."""
    return F.transform(F.filter(F.split(F.lower(text), _GAP), lambda w: w != ""),
                       lambda w: F.xxhash64(w))


def shingles(words: Column) -> Column:
    """Hash of every 5-gram of an array of word hashes (empty below 5 words)."""
    last = F.size(words) - SHINGLE
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))
    ).otherwise(F.array().cast("array<bigint>"))


def simhash(words: Column) -> Column:
    """64-bit SimHash: each bit is the majority over the words.

    Two counters share one long, 32 bits apart, so 32 passes count all bits.
    """
    low = F.lit(0x0000000100000001).cast("bigint")
    half = F.size(words).cast("bigint")
    out = F.lit(0).cast("bigint")

    def pairs(k: int) -> Column:
        """Counts of bits k (lower half) and k + 32 (upper half)."""
        return F.aggregate(words, F.lit(0).cast("bigint"),
                           lambda a, x: a + F.shiftrightunsigned(x, k).bitwiseAND(low))

    for k in range(32):
        both = pairs(k)
        lower = both.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
        upper = F.shiftrightunsigned(both, 32)
        for count, bit in ((lower, k), (upper, k + 32)):
            value = (1 << bit) if bit < 63 else -(1 << 63)
            out = out.bitwiseOR(F.when(count * 2 > half, F.lit(value).cast("bigint"))
                                .otherwise(F.lit(0).cast("bigint")))
    return out


def _blocks(fingerprint: Column) -> Column:
    """(number, value) of each of the RADIUS + 1 blocks of a fingerprint."""
    n, parts, at = RADIUS + 1, [], 0
    for k in range(n):
        width = 64 // n + (1 if k < 64 % n else 0)
        mask = F.lit((1 << width) - 1).cast("bigint")
        parts.append(F.struct(F.lit(k).alias("block"),
                              F.shiftrightunsigned(fingerprint, at).bitwiseAND(mask)
                              .alias("value")))
        at += width
    return F.explode(F.array(*parts))


def _least(n: Column) -> Column:
    """Common 5-grams that similarity THRESHOLD with an item of ``n`` words takes."""
    return F.ceil(F.lit(THRESHOLD) * (n - (SHINGLE - 1))).cast("int")


def _starts(places: Column, n: Column) -> Column:
    """Starts (below 0: clipped) of all windows of ``n`` words that hold at least
    ``_least(n)`` of the sorted places."""
    span, least = n - SHINGLE, _least(n)
    first = F.filter(F.sequence(F.lit(0), F.size(places) - least),
                     lambda j: F.get(places, j + least - 1) - F.get(places, j) <= span)
    return F.array_distinct(F.flatten(F.transform(first, lambda j: F.sequence(
        F.get(places, j + least - 1) - span, F.get(places, j)))))


def _rarest(items: DataFrame) -> DataFrame:
    """The 5-grams of each item that the fewest items of its size have, one more
    than a window of similarity THRESHOLD can miss: it has at least one of them."""
    own = items.select("item_id", "n", F.explode(F.array_distinct("s")).alias("shingle"))
    known = own.groupBy("n", "shingle").agg(F.count(F.lit(1)).alias("owners"))
    each = (own.join(known, ["n", "shingle"]).groupBy("item_id", "n")
            .agg(F.sort_array(F.collect_set(F.struct("owners", "shingle"))).alias("by")))
    spare = F.col("n") - (SHINGLE - 1) - _least(F.col("n"))
    return (each.select("item_id", "n", F.explode(F.slice("by", F.lit(1), spare + 1)).alias("x"))
            .select("item_id", "n", "x.shingle"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Contaminated texts: ``doc_id``, ``text_hash``, ``item_ids`` (sorted)."""
    items = stage(
        benchmark.where(F.col("text").isNotNull())
        .select("item_id", word_hashes(F.col("text")).alias("w"))
        .where(F.size("w") >= SHINGLE).distinct()
        .withColumn("n", F.size("w")).withColumn("s", shingles(F.col("w")))
        .withColumn("fp", simhash(F.col("w"))), "decontam-items")
    keys = stage(items.select("n", F.explode("s").alias("shingle")).distinct(),
                 "decontam-keys")
    if keys.count() <= BROADCAST_SHINGLES:
        keys = F.broadcast(keys)
    # Only places and 5-grams travel; the words follow once per leaking text.
    texts = (docs.where(F.col(text).isNotNull())
             .select("doc_id", F.xxhash64(F.col(text)).alias("text_hash"),
                     F.col(text).alias("t")))
    grams = (texts.select("doc_id", "text_hash", word_hashes(F.col("t")).alias("w"))
             .where(F.size("w") >= SHINGLE)
             .select("doc_id", "text_hash", F.posexplode(shingles(F.col("w")))
                     .alias("i", "shingle")))
    hits = (grams.join(keys, "shingle").groupBy("doc_id", "text_hash", "n")
            .agg(F.sort_array(F.collect_set("i")).alias("p"))
            .where(F.size("p") >= _least(F.col("n"))))
    starts = stage(hits.withColumn("at", _starts(F.col("p"), F.col("n"))).drop("p")
                   .where(F.size("at") > 0), "decontam-starts")
    leaky = starts.select("text_hash").distinct()
    if leaky.count() <= BROADCAST_SHINGLES:
        leaky = F.broadcast(leaky)
    words = (texts.join(leaky, "text_hash", "left_semi")
             .dropDuplicates(["doc_id", "text_hash"])
             .select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"),
                     word_hashes(F.col("t")).alias("w")))
    cut = (starts.join(words, F.col("doc_id").eqNullSafe(F.col("d"))
                       & (F.col("text_hash") == F.col("h")))
           .select("doc_id", "text_hash", "n", "w", F.explode("at").alias("at"))
           .select("doc_id", "text_hash", "n",
                   F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1,
                           F.col("n") + F.least(F.col("at"), F.lit(0))).alias("w")))
    windows = stage(cut.withColumn("content", F.xxhash64("n", "w")), "decontam-windows")
    contents = (windows.groupBy("content", "n").agg(F.first("w").alias("w"))
                .withColumn("fp", simhash(F.col("w"))))
    contents = stage(contents, "decontam-contents")
    near = (contents.select("content", "n", "fp", _blocks(F.col("fp")).alias("b"))
            .select("content", "n", "fp", "b.block", "b.value")
            .join(items.select("item_id", "n", F.col("fp").alias("item_fp"),
                               _blocks(F.col("fp")).alias("b"))
                  .select("item_id", "n", "item_fp", "b.block", "b.value"),
                  ["n", "block", "value"])
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
            .select("content", "n", "item_id"))
    bags = stage(contents.select("content", "n", F.explode(shingles(F.col("w"))).alias("shingle"))
                 .groupBy("content", "n", "shingle").agg(F.count(F.lit(1)).alias("c")),
                 "decontam-bags")
    # The exact way, for pairs whose fingerprints lie further apart.
    shared = bags.join(_rarest(items), ["n", "shingle"]).select("content", "n", "item_id")
    near = stage(near.union(shared).distinct(), "decontam-pairs")
    # Exact comparison of bags: the maxima follow from the sizes and the minima.
    have = near.join(bags, ["content", "n"])
    want = (items.select("item_id", F.explode("s").alias("shingle"))
            .groupBy("item_id", "shingle").agg(F.count(F.lit(1)).alias("k")))
    sizes = (near.join(contents.select("content", "n", F.size("w").alias("len")),
                       ["content", "n"]))
    common = (have.join(want, ["item_id", "shingle"])
              .groupBy("content", "n", "item_id").agg(F.sum(F.least("c", "k")).alias("common")))
    total = F.col("len") + F.col("n") - 2 * (SHINGLE - 1)
    leaked = (common.join(sizes, ["content", "n", "item_id"])
              .where(F.col("common") >= F.lit(THRESHOLD) * (total - F.col("common")))
              .groupBy("content", "n").agg(F.collect_set("item_id").alias("items")))
    return (windows.join(leaked, ["content", "n"])
            .groupBy("doc_id", "text_hash")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
                 .alias("item_ids")))


def mark(docs: DataFrame, leaks: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``leaked_items`` (empty where clean), which
    replaces a column of that name."""
    found = leaks.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"),
                         F.col("item_ids").alias("__items"))
    return (docs.drop("leaked_items").withColumn("__t", F.xxhash64(F.col(text)))
            .join(found, F.col("doc_id").eqNullSafe(F.col("__d"))
                  & (F.col("__t") == F.col("__h")), "left")
            .withColumn("__items", F.coalesce("__items", F.array().cast(
                dict(leaks.dtypes)["item_ids"])))
            .drop("__t", "__d", "__h").withColumnRenamed("__items", "leaked_items"))

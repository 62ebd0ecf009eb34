"""Repeated passages by a sparse suffix array.

Of every text only some suffixes are kept: in each window of ``MIN_WORDS``
words, among the first ``MIN_WORDS - BLOCK + 1`` places, the one whose 5-gram
hash is least (the leftmost of equals). The choice depends on the window's
words alone, so two texts that share a window keep the same suffix of it, and
that suffix's first ``BLOCK`` words lie inside the window.

Suffixes are sorted by those first words; a suffix whose block occurs in no
other text has no match and is left out. The others are sorted again for
every way of splitting ``MIN_WORDS`` into words to the left and to the right
of the suffix, and neighbours are compared: equal neighbours of different
texts share a whole window, and the suffix's match is extended to it. The
union of all matched windows of a text, over all its kept suffixes, is exactly
the set of words covered by a window of ``MIN_WORDS`` words that another
document holds too.

Equal texts are one text here; if two documents hold it, all of it is
repeated. Blocks with more than ``HOT`` suffixes are not brought into one
task: their windows are counted by their hashes instead (partial sums first),
with the same result.

Words are runs of bytes other than ASCII white space, compared exactly.
Defined results: null, empty and shorter texts have no spans; windows that
repeat inside one text only do not count; repeated rows are two documents;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import textkernel as K

MIN_WORDS = 50
BLOCK = 25
ORDER = 5
HOT = 50_000
SPLITS = MIN_WORDS - BLOCK + 1
U64 = np.uint64


def _sparse(w: K.Words) -> np.ndarray:
    """Kept suffixes (word indices), ascending."""
    n = len(w.hash)
    if n < MIN_WORDS:
        return np.zeros(0, np.int64)
    order = K.Prefix(w.hash, K._WORD_BASE).ranges(np.arange(n - ORDER + 1),
                                                  np.arange(ORDER, n + 1))
    start = np.arange(n - MIN_WORDS + 1)
    start = start[w.row[start] == w.row[start + MIN_WORDS - 1]]
    if not len(start):
        return start
    view = np.lib.stride_tricks.sliding_window_view(order, SPLITS)
    return np.unique(view[start].argmin(axis=1) + start)


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in K.slices(b, "text"):
            w = K.words_of(s.data, s.offsets)
            rows = len(s.offsets) - 1
            at = _sparse(w)
            block = K.Prefix(w.hash, K._WORD_BASE).ranges(at, at + BLOCK)
            off = np.searchsorted(w.row[at], np.arange(rows + 1)).astype(np.int32)
            place = (at - w.first[w.row[at]]).astype(np.int32)
            # A text that repeats itself has a block many times; it counts once.
            _, one = np.unique(np.stack([w.row[at].astype(U64), block]), axis=1,
                               return_index=True)
            own = np.searchsorted(w.row[at][one], np.arange(rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [s.batch.column(0), s.batch.column(1),
                 pa.array(np.diff(w.first).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(off), pa.array(block.view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(off), pa.array(place)),
                 pa.ListArray.from_arrays(pa.array(own), pa.array(block[one].view(np.int64)))],
                names=["doc_id", "text_hash", "n_words", "blocks", "places", "distinct"])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every wanted suffix, the hashes of the windows around it: entry l is
    the window that starts l words to the left (0 where the text ends). Places
    of one text with equal windows (a text that repeats itself) share a row."""
    for b in batches:
        for s in K.slices(b, "text"):
            w = K.words_of(s.data, s.offsets)
            lists = s.batch.column("places")
            per = np.diff(np.concatenate([[0], np.cumsum(
                [len(x) for x in lists])])).astype(np.int64)
            row = np.repeat(np.arange(len(per)), per)
            at = lists.flatten().to_numpy().astype(np.int64) + w.first[row]
            prefix = K.Prefix(w.hash, K._WORD_BASE)
            block = prefix.ranges(at, at + BLOCK)
            out = np.zeros((len(at), SPLITS), U64)
            for left in range(SPLITS):
                a = at - left
                ok = (a >= w.first[row]) & (a + MIN_WORDS <= w.first[row + 1])
                out[ok, left] = prefix.ranges(a[ok], a[ok] + MIN_WORDS)
            texts = s.batch.column("text_hash").to_numpy()[row]
            place = (at - w.first[row]).astype(np.int32)
            hot = np.concatenate([np.asarray(x.as_py(), bool)
                                  for x in s.batch.column("hot")]) if len(at) else at > 0
            key = K.Prefix(out.ravel(), K._WORD_BASE).ranges(
                np.arange(len(at)) * SPLITS, np.arange(1, len(at) + 1) * SPLITS)
            o = np.lexsort((place, key, texts))
            new = np.ones(len(o), bool)
            new[1:] = (key[o][1:] != key[o][:-1]) | (texts[o][1:] != texts[o][:-1])
            first = np.flatnonzero(new)
            one = o[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[one].view(np.int64)), pa.array(texts[one]),
                 pa.ListArray.from_arrays(pa.array(np.append(first, len(o)).astype(np.int32)),
                                          pa.array(place[o])),
                 pa.array(hot[one]),
                 pa.ListArray.from_arrays(
                     pa.array(np.arange(0, (len(one) + 1) * SPLITS, SPLITS, dtype=np.int32)),
                     pa.array(out[one].ravel().view(np.int64)))],
                names=["block", "text_hash", "places", "hot", "windows"])


def _matched(block: np.ndarray, text: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which windows of which suffixes another text holds: sort by (block,
    window, text) for every split and compare neighbours."""
    hit = np.zeros(windows.shape, bool)
    for left in range(windows.shape[1]):
        own = windows[:, left]
        o = np.lexsort((text, own, block))
        b, x, t = block[o], own[o], text[o]
        new = np.ones(len(o), bool)
        new[1:] = (b[1:] != b[:-1]) | (x[1:] != x[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(o)) - 1
        several = (t[first] != t[last]) & (x[first] != 0)
        hit[o, left] = np.repeat(several, last - first + 1)
    return hit


_HIT = "text_hash bigint, places array<int>, near int, far int"


def _hits(t: pa.Table) -> pa.RecordBatch | None:
    """Rows with a match, and their least and greatest left extension."""
    t = t.combine_chunks()
    if not t.num_rows:
        return None
    windows = t.column("windows").chunk(0).flatten().to_numpy().view(U64)
    hit = _matched(t.column("block").to_numpy(), t.column("text_hash").to_numpy(),
                   windows.reshape(-1, SPLITS))
    some = np.flatnonzero(hit.any(axis=1))
    if not len(some):
        return None
    part = t.take(pa.array(some)).combine_chunks()
    near = hit[some].argmax(axis=1)
    far = SPLITS - 1 - hit[some][:, ::-1].argmax(axis=1)
    return pa.RecordBatch.from_arrays(
        [part.column("text_hash").chunk(0), part.column("places").chunk(0),
         pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32))],
        names=["text_hash", "places", "near", "far"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of the suffixes of whole blocks; rows come sorted by block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        block = b.column(0).to_numpy()
        if block[0] == block[-1] and sum(h.num_rows for h in held) < HOT:
            continue
        t = pa.Table.from_batches(held)
        last = int(np.searchsorted(t.column("block").to_numpy(), block[-1]))
        out = _hits(t.slice(0, last))
        if out is not None:
            yield out
        held = t.slice(last).combine_chunks().to_batches()
    if held:
        out = _hits(pa.Table.from_batches(held))
        if out is not None:
            yield out


def _merge(spans):
    """Union of intervals, as a column expression over a sorted array."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, s):
        last = F.get(acc, F.size(acc) - 1)     # null while acc is empty
        grown = F.struct(last["start"].alias("start"),
                         F.greatest(last["end"], s["end"]).alias("end"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        return F.when(s["start"] <= last["end"],
                      F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), grown)
                      ).otherwise(F.array_append(acc, own))

    return F.aggregate(F.array_sort(spans), empty, step)


def repeated_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``spans`` (word
    intervals, end exclusive, that other documents hold too), ``n_repeated``."""
    src = docs.select("doc_id", F.xxhash64(F.col(text)).alias("text_hash"),
                      F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = dict(src.dtypes)["doc_id"]
    kept = stage(src.select("doc_id", "text_hash", "text").mapInArrow(
        _suffix_rows, f"doc_id {id_type}, text_hash bigint, n_words bigint, "
                      "blocks array<bigint>, places array<int>, distinct array<bigint>"),
        "suffixes")
    texts = (kept.groupBy("text_hash")
             .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    suffixes = kept.select("text_hash", F.explode(F.arrays_zip("blocks", "places"))
                           .alias("x")).select("text_hash", "x.blocks", "x.places")
    shared = (kept.select("text_hash", F.explode("distinct").alias("block")).groupBy("block")
              .agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"),
                   F.count(F.lit(1)).alias("n"))
              .where("a <> b").select("block", (F.col("n") > HOT).alias("hot")))
    wanted = (suffixes.join(shared, suffixes["blocks"] == shared["block"])
              .groupBy("text_hash")
              .agg(F.array_sort(F.collect_set(F.struct(F.col("places").alias("place"), "hot")))
                   .alias("x"))
              .join(texts, "text_hash")
              .select(F.col("text_hash").alias("__h"), "rep", F.col("x.place").alias("places"),
                      F.col("x.hot").alias("hot")))
    contexts = stage(
        src.join(wanted, src["doc_id"].eqNullSafe(wanted["rep"])
                 & (src["text_hash"] == wanted["__h"]))
        .select("text_hash", "places", "hot", "text")
        .mapInArrow(_context_rows, "block bigint, text_hash bigint, places array<int>, "
                                   "hot boolean, windows array<bigint>"), "suffix-contexts")
    found = (contexts.where("not hot").select("block", "text_hash", "places", "windows")
             .repartition("block").sortWithinPartitions("block")
             .mapInArrow(_compare, _HIT))
    # Hot blocks: every window by itself, summed up before the shuffle.
    windows = (contexts.where("hot")
               .select("text_hash", "places", F.posexplode("windows").alias("left", "window"))
               .where("window <> 0"))
    several = (windows.groupBy("window")
               .agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
               .where("a <> b").select("window"))
    hot = (windows.join(several, "window")
           .select("text_hash", "places", F.col("left").alias("near"),
                   F.col("left").alias("far")))
    spans = (found.unionByName(hot)
             .select("text_hash", "near", "far", F.explode("places").alias("place"))
             .select("text_hash", (F.col("place") - F.col("far")).alias("start"),
                     (F.col("place") - F.col("near") + MIN_WORDS).alias("end"))
             .groupBy(F.col("text_hash").alias("__h"))
             .agg(_merge(F.collect_set(F.struct("start", "end"))).alias("spans")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = (kept.select("doc_id", "text_hash", "n_words")
           .join(texts.select("text_hash", "copies"), "text_hash")
           .join(spans, F.col("text_hash") == F.col("__h"), "left")
           .withColumn("spans", F.when((F.col("copies") > 1) & (F.col("n_words") >= MIN_WORDS),
                                       whole).otherwise(F.coalesce("spans", none))))
    return out.select("doc_id", "n_words", "spans", F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
        .alias("n_repeated"))

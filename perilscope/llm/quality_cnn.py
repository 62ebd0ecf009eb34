"""Byte-level convolutional quality classifier in numpy.

A text is its UTF-8 bytes. Every byte has a learned vector; ``FILTERS`` filters
look at ``WIDTH`` neighbouring bytes at every position. The positions are cut
into chunks of ``CHUNK``; a chunk's last windows reach into the next chunk, so
chunks overlap and no window is missed. Each filter is max-pooled per chunk,
the chunks' maxima are averaged over the document (weighted by their windows)
and a logistic layer gives one probability. The whole text counts, whatever
its length, and memory is bounded by a slice of texts.

The model is fitted on the driver on at most ``SAMPLE`` labelled rows per
class (least hash of doc_id first) of at most ``SAMPLE_BYTES`` bytes each. The
held-out fold (crc32 of the id as text, modulo 5, equal to 0) is never used.
Only the text enters a score.

Defined results: null text reads as empty; an empty text has the score of the
bias alone; without labelled rows of both classes every score is the share of
the one class present (0.5 without any); a null id is not held out; documents
with several label rows take their least label; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

WIDTH = 6
DIM = 4
FILTERS = 16
CHUNK = 256
SAMPLE = 600
SAMPLE_BYTES = 32_768
EPOCHS = 24
BATCH = 48
RATE = 0.02
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Model:
    """Parameters and the two passes over a batch of texts."""

    def __init__(self, rng: np.random.Generator):
        self.p = {
            "E": rng.normal(0, 0.5, (257, DIM)).astype(np.float32),   # 256 pads
            "W": rng.normal(0, 0.3, (WIDTH * DIM, FILTERS)).astype(np.float32),
            "c": np.zeros(FILTERS, np.float32),
            "v": rng.normal(0, 0.1, FILTERS).astype(np.float32),
            "b": np.zeros(1, np.float32),
        }
        self.p["E"][256] = 0

    def _features(self, data: np.ndarray, offsets: np.ndarray):
        """Pooled features of every text, and what the backward pass needs."""
        size = np.diff(offsets)
        chunks = -(-size // CHUNK)
        total = int(chunks.sum())
        feature = np.zeros((len(size), FILTERS), np.float32)
        if total == 0:
            return feature, None
        first = np.cumsum(chunks) - chunks
        x = np.full(total * CHUNK + WIDTH - 1, 256, np.int64)
        shift = np.repeat(first * CHUNK - offsets[:-1], size)
        x[np.arange(len(data)) + shift] = data
        doc = np.repeat(np.arange(len(size)), chunks)
        k = np.arange(total) - first[doc]
        valid = np.minimum(CHUNK, size[doc] - k * CHUNK)
        weight = (valid / size[doc]).astype(np.float32)
        best = np.empty((total, FILTERS), np.float32)
        where = np.empty((total, FILTERS), np.int64)
        for i in range(0, total, 128):
            j = min(total, i + 128)
            z = self._windows(x, np.arange(i * CHUNK, j * CHUNK)) @ self.p["W"] + self.p["c"]
            z = z.reshape(j - i, CHUNK, FILTERS)
            # Windows that start past the text's end do not count.
            short = np.flatnonzero(valid[i:j] < CHUNK)
            for s in short:
                z[s, valid[i + s]:] = -1
            best[i:j] = z.max(axis=1)
            where[i:j] = z.argmax(axis=1) if self._train else 0
        np.maximum(best, 0, out=best)
        np.add.at(feature, doc, best * weight[:, None])
        return feature, (x, doc, weight, best, where)

    _train = False

    def _windows(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) and at[-1] - at[0] == len(at) - 1:      # a run of neighbours
            e = self.p["E"][x[at[0]:at[-1] + WIDTH]]
            out = np.empty((len(at), WIDTH * DIM), np.float32)
            for j in range(WIDTH):
                out[:, j * DIM:(j + 1) * DIM] = e[j:j + len(at)]
            return out
        return self.p["E"][x[at[:, None] + np.arange(WIDTH)]].reshape(len(at), -1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        f, _ = self._features(data, offsets)
        z = (f @ self.p["v"] + self.p["b"]).astype(np.float64)
        return 1 / (1 + np.exp(-z))

    def gradients(self, data, offsets, y, weight):
        self._train = True
        f, kept = self._features(data, offsets)
        self._train = False
        prob = 1 / (1 + np.exp(-(f @ self.p["v"] + self.p["b"])))
        dz = ((prob - y) * weight / weight.sum()).astype(np.float32)
        g = {"v": f.T @ dz, "b": dz.sum(keepdims=True)}
        if kept is None:
            return g
        x, doc, w, best, where = kept
        dbest = dz[doc, None] * self.p["v"] * w[:, None] * (best > 0)
        g["W"], g["c"] = np.zeros_like(self.p["W"]), dbest.sum(axis=0)
        g["E"] = np.zeros_like(self.p["E"])
        start = np.arange(len(doc))[:, None] * CHUNK + where
        for k in range(FILTERS):
            on = np.flatnonzero(dbest[:, k])
            if not len(on):
                continue
            at, d = start[on, k], dbest[on, k]
            g["W"][:, k] = self._windows_at(x, at).T @ d
            for j in range(WIDTH):
                own = x[at + j]
                for m in range(DIM):
                    g["E"][:, m] += np.bincount(own, d * self.p["W"][j * DIM + m, k], 257)
        g["E"][256] = 0
        return g

    def _windows_at(self, x, at):
        return self.p["E"][x[at[:, None] + np.arange(WIDTH)]].reshape(len(at), -1)


def fit(texts: list[bytes], labels: list[int], seed: int = 7) -> Model:
    """Adam on class-balanced log loss."""
    rng = np.random.default_rng(seed)
    model = Model(rng)
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        model.p["v"][:] = 0
        model.p["b"][:] = np.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6),
                                                                          1 - 1e-6)))
        return model
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    var = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i:i + BATCH]
            parts = [texts[k] for k in own]
            data = np.frombuffer(b"".join(parts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in parts])])
            step += 1
            for k, g in model.gradients(data, offsets, y[own], weight[own]).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                model.p[k] -= (rate * (mean[k] / (1 - 0.9 ** step))
                               / (np.sqrt(var[k] / (1 - 0.99 ** step)) + 1e-7)
                               ).astype(np.float32)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE
                  ) -> tuple[list[bytes], list[int]]:
    """At most ``sample`` rows of each class, none of the held-out fold."""
    own = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
                        & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.min("quality").alias("quality"))
           .join(docs.where(F.octet_length("text") <= SAMPLE_BYTES)
                 .select("doc_id").distinct(), "doc_id", "left_semi"))
    picked = [own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id")
              .limit(sample) for q in (0, 1)]
    ids = picked[0].unionByName(picked[1])          # at most 2 * sample rows
    rows = (docs.where(F.octet_length("text") <= SAMPLE_BYTES)
            .join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"),
                                   F.min("quality").alias("quality"))
            .orderBy("doc_id").collect())
    return [r["text"].encode() for r in rows], [r["quality"] for r in rows]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select("doc_id", F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in K.slices(b, "text"):
                yield pa.RecordBatch.from_arrays(
                    [s.batch.column(0), pa.array(shared.value.score(s.data, s.offsets))],
                    names=["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows and score every document."""
    return score(docs, fit(*training_rows(docs, labels)))

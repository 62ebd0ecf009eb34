"""Hard-negative mining by Kronecker-packed integer products.

Vectors are quantised to integers. Several candidates' components, each made
non-negative by a bias, sit in separated fields of one wide integer, so one
multiplication by an (also biased) anchor component multiplies all of them,
and the sum over components holds one exact inner product per field. The
biases are subtracted after unpacking. Fields are as wide as the largest
possible sum of the block, so they never carry into each other. For ordinary
embeddings two or more fit in the 53 bits that a double holds exactly, so the
wide integers are doubles and the sums one exact matrix product; for larger
components they are Python integers of ``BIG_FIELDS`` fields, without limit.

Rows are dealt into blocks of about ``BLOCK``; a *cell* is one block of
anchors against one block of candidates, and is the unit of work of a task.
The first pass compares anchors with the rows of their own label, the second
with all rows, under the bounds that the anchor's positives set. Each cell
returns a few rows per anchor, and no pair of rows ever becomes a table row.

Defined results of odd input: a row with a null ``vec_id``, label or vector,
or with a null, NaN or infinite component takes no part; rows that share a
``vec_id`` are one row, the least by (label, components); a shorter vector
counts as padded with zeros (an empty one has score 0 with all); equal scores
rank by smaller ``vec_id``; scores beyond +-2**56 are held there; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

BLOCK = 1024
STRIP = 256             # anchors scored at once in a task
SIGNIFICAND = 53        # bits of an integer that a double holds exactly
BIG_FIELDS = 8          # fields of a Python integer
BOUND = 1 << 56
NONE = np.iinfo(np.int64).min

POSITIVES = 5
NEGATIVES = 3
SCALE = 256


# -- packed products ------------------------------------------------------------

def pack(rows: np.ndarray, bias: int, width: int, fields: int, wide: type) -> np.ndarray:
    """``(n, d)`` integers -> ``(d, ceil(n / fields))`` wide integers; candidate
    ``i`` is field ``i % fields`` of word ``i // fields``."""
    n, d = rows.shape
    words = np.zeros((d, -(-n // fields)), wide)
    for f in range(fields):
        part = rows[f::fields].astype(wide) + bias
        words[:, :len(part)] += part.T * wide_power(f * width, wide)
    return words


def wide_power(bits: int, wide: type):
    return 1 << bits if wide is object else float(1 << bits)


def unpack(sums: np.ndarray, width: int, fields: int, n: int) -> np.ndarray:
    """Fields of ``(a, words)`` sums as ``(a, n)``."""
    if sums.dtype != object:
        sums = sums.astype(np.int64)
    out = np.empty((sums.shape[0], sums.shape[1] * fields), sums.dtype)
    for f in range(fields):
        out[:, f::fields] = (sums >> (f * width)) & ((1 << width) - 1)
    return out[:, :n]


def scorer(candidates: np.ndarray):
    """A function from ``(a, d)`` anchors to their ``(a, n)`` exact scores,
    held within +-``BOUND``; ``candidates`` are packed once per field width."""
    n, d = candidates.shape
    bias_c = _most(candidates) if candidates.size else 0
    packed: dict[int, np.ndarray] = {}

    def scores(anchors: np.ndarray) -> np.ndarray:
        if not anchors.size or not candidates.size:
            return np.zeros((len(anchors), n), np.int64)
        bias_a = _most(anchors)
        width = max(1, (4 * d * bias_c * bias_a).bit_length())
        fields = SIGNIFICAND // width
        wide = np.float64
        if fields < 2:
            fields, wide = BIG_FIELDS, object
        if width not in packed:
            packed[width] = pack(candidates, bias_c, width, fields, wide)
        sums = unpack((anchors.astype(wide) + bias_a) @ packed[width], width, fields, n)
        whole = object if wide is object else np.int64
        own = anchors.astype(whole).sum(axis=1)[:, None]
        total = candidates.astype(whole).sum(axis=1)[None, :]
        sums = sums - bias_c * own - bias_a * total - d * bias_c * bias_a
        return np.clip(sums, -BOUND, BOUND).astype(np.int64)

    return scores


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min())))


def best(scores: np.ndarray, allowed: np.ndarray, k: int):
    """Column and score of each row's ``k`` highest allowed entries, first
    columns first among equals: ``[(rows, columns, scores), ...]``."""
    left = np.where(allowed, scores, NONE)
    rows = np.arange(len(left))
    for _ in range(k):
        if not left.shape[1]:
            return
        col = left.argmax(axis=1)
        top = left[rows, col]
        have = np.flatnonzero(top != NONE)
        if not len(have):
            return
        yield have, col[have], top[have]
        left[rows, col] = NONE


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    """A list column as ``(n, d)`` integers, short rows padded with zeros."""
    size = col.value_lengths().to_numpy()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(col), d), np.int64)
    out[np.arange(d)[None, :] < size[:, None]] = flat
    return out


def _sides(table: pa.Table):
    """Anchors and candidates of a cell; candidates in order of ``vec_id``."""
    table = table.combine_chunks()
    is_anchor = table["anchor"].to_numpy()
    d = int(max(table["q"].combine_chunks().value_lengths().to_numpy(), default=0))
    out = []
    for part in (table.filter(pa.array(is_anchor)),
                 table.filter(pa.array(~is_anchor)).sort_by("vec_id")):
        part = part.combine_chunks()
        q = part["q"].combine_chunks()
        out.append((part, part["vec_id"].to_numpy(), part["label"].to_numpy(), _matrix(q, d)))
    return out


def _rows(columns: dict, found: list) -> pa.Table:
    parts = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)
             for k in range(len(columns))]
    return pa.table({c: pa.array(p, pa.int64()) for c, p in zip(columns, parts)})


POSITIVE_ROWS = dict.fromkeys(["anchor_id", "positive_id", "positive_score"], "bigint")
NEGATIVE_ROWS = dict.fromkeys(["anchor_id", "positive_id", "positive_score",
                               "negative_id", "negative_score"], "bigint")


def _ddl(columns: dict) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def _positives(table: pa.Table, k: int) -> pa.Table:
    """Of each anchor of a cell, its ``k`` best candidates (all of its label)."""
    (_, ids, _, q), (_, cids, _, cq) = _sides(table)
    score, found = scorer(cq), []
    for at in range(0, len(ids), STRIP):
        own = ids[at:at + STRIP]
        s = score(q[at:at + STRIP])
        for r, c, v in best(s, own[:, None] != cids[None, :], k):
            found.append((own[r], cids[c], v))
    return _rows(POSITIVE_ROWS, found)


def _negatives(table: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """Of each anchor and positive of a cell, the ``k`` best candidates of
    another label within the positive's bounds."""
    (part, ids, labels, q), (_, cids, clabels, cq) = _sides(table)
    score, found = scorer(cq), []
    have = part["positives"].combine_chunks()
    count = have.value_lengths().to_numpy()
    flat = have.flatten()
    pid = flat.field("positive_id").to_numpy()
    pscore = flat.field("positive_score").to_numpy()
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    for at in range(0, len(ids), STRIP):
        own = slice(at, at + STRIP)
        s = score(q[own])
        other = labels[own, None] != clabels[None, :]
        for j in range(int(count[own].max(initial=0))):
            rows = np.flatnonzero(count[own] > j)
            place = first[own][rows] + j
            p = pscore[place][:, None]
            inside = other[rows] & (low * p <= 100 * s[rows]) & (100 * s[rows] <= high * p)
            for r, c, v in best(s[rows], inside, k):
                found.append((ids[own][rows[r]], pid[place[r]], pscore[place[r]], cids[c], v))
    return _rows(NEGATIVE_ROWS, found)


# -- the operator -----------------------------------------------------------------

def quantise(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(rows: DataFrame, vec_id: str, vector: str, label: Column,
           scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, q)`` of the rows that take part, one per ``vec_id``."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == float("inf")))
    rows = (rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()
                       & label.isNotNull() & ~bad)
            .select(F.col(vec_id).cast("bigint").alias("vec_id"),
                    F.struct(label.cast("bigint").alias("label"),
                             quantise(F.col(vector), scale).alias("q")).alias("row")))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select(
        "vec_id", "row.label", "row.q")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("vec_id"), blocks)


def _blocks(n: str) -> Column:
    return F.ceil(F.col(n) / F.lit(BLOCK)).cast("bigint")


def _cells(anchors: DataFrame, rows: DataFrame, extra: list[str]) -> DataFrame:
    """Rows of both sides beside the cells they meet in; their ``ab`` and ``cb``
    are the numbers of anchor and candidate blocks."""
    columns = ["c", "a", "anchor", "vec_id", "label", "q", *extra]
    left = (anchors.withColumn("a", _block(F.col("ab"))).withColumn("anchor", F.lit(True))
            .withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cb") - 1))))
    right = (rows.withColumn("c", _block(F.col("cb"))).withColumn("anchor", F.lit(False))
             .withColumn("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ab") - 1))))
    for c in extra:
        right = right.withColumn(c, F.lit(None).cast(anchors.schema[c].dataType))
    return left.select(*columns).unionByName(right.select(*columns))


def _top(found: DataFrame, by: list[str], score: str, name: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(name))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of :func:`usable` rows.

    An anchor's positives are its ``positives`` best other rows of its label;
    per anchor and positive the first ``negatives`` rows of another label with
    ``low * positive_score <= 100 * score <= high * positive_score`` come back
    as ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``.
    """
    rows = stage(rows.withColumn("is_anchor", is_anchor), "negatives-rows")
    # Pass 1: cells within a label, as many as the label's rows need.
    sizes = (rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("na"))
        .where("na > 0").select("label", _blocks("n").alias("cb"), _blocks("na").alias("ab")))
    sized = rows.join(sizes, "label")
    cells = _cells(sized.where("is_anchor"), sized, [])
    near = cells.groupBy("label", "c", "a").applyInArrow(
        lambda t: _positives(t, positives), _ddl(POSITIVE_ROWS))
    near = (_top(near, ["anchor_id"], "positive_score", "positive_id", positives)
            .groupBy("anchor_id").agg(F.collect_list(
                F.struct("positive_id", "positive_score")).alias("positives")))
    anchors = (rows.where("is_anchor").join(near, F.col("vec_id") == F.col("anchor_id"))
               .select("vec_id", "label", "q", "positives"))
    # Pass 2: cells of all rows; the numbers of blocks are one row.
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("na"))
    n = F.broadcast(n.select(_blocks("n").alias("cb"), _blocks("na").alias("ab")))
    cells = _cells(anchors.crossJoin(n), rows.crossJoin(n), ["positives"])
    hard = cells.groupBy("c", "a").applyInArrow(
        lambda t: _negatives(t, negatives, low, high), _ddl(NEGATIVE_ROWS))
    hard = _top(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id",
                       "positive_score", "negative_score")

"""Byte-level BPE: pre-tokenise overlapping chunks, stitch, merge, decode.

A text is cut into pieces by the tokenizer's pattern (contractions, an
optional space with letters, digits or other marks, white space), and every
piece is merged by the rank file. Pieces are found on code-point classes, not
by a regular expression: runs of one class, then the rules for a joined
space, the last character of white space and contractions.

Texts of at most ``CHUNK`` code points are one chunk. Longer ones become
overlapping chunks, spread over the cluster and pre-tokenised in parallel.
The chunks of a text then meet again and are stitched: from a position where
both neighbours start a piece on, the later chunk's pieces hold, because a
piece never depends on the text before it. Where an overlap has no such
position (one piece longer than the overlap) the two chunks are joined and
cut again. Merging works on the distinct pieces of a slice of texts only.

Defined results: null text encodes as empty; repeated rows (same id and text)
come out as often as they went in; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkernel as K

CHUNK = 1 << 16       # code points of a chunk
OVERLAP = 1 << 10     # code points that a chunk shares with the one before
CACHE = 200_000       # merged pieces that a worker keeps

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point, from the pattern's own character classes."""
    import regex
    table = np.zeros(0x110000, np.uint8)
    for low in range(0, 0x110000, 1 << 14):
        points = [c for c in range(low, low + (1 << 14)) if not 0xD800 <= c < 0xE000]
        every = "".join(map(chr, points))
        at = np.array(points, np.int64)
        for code, cls in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(cls, every):
                table[at[m.start():m.end()]] = code
    return table


class Vocabulary:
    """Ranks of a ``.tiktoken`` file, and the bytes of every id."""

    def __init__(self, raw: bytes):
        pairs = [line.split() for line in raw.splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        by_id = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.tokens = pa.array(by_id, pa.large_binary())
        self.merged: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """Ids of a piece, packed as 32-bit integers."""
        got = self.merged.get(piece)
        if got is None:
            if len(self.merged) >= CACHE:
                self.merged.clear()
            got = np.array(self._merge(piece), np.int32).tobytes()
            if len(piece) <= 64:
                self.merged[piece] = got
        return got

    def _merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        # A list of parts linked by position; the heap holds candidate pairs,
        # stale ones are skipped when they come up.
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i:i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, j = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != j:
                continue
            gone = end[i]
            alive[gone] = False
            end[i] = j
            if j < n:
                before[j] = i
                r = ranks.get(piece[i:end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[j]))
            p = before[i]
            if p >= 0:
                r = ranks.get(piece[p:j])
                if r is not None:
                    heapq.heappush(heap, (r, p, j))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def _vocabulary(raw: bytes) -> Vocabulary:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(raw)
    return _VOCABULARIES[key]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start: one flag per code point. ``first`` holds the start of
    every text and the total length."""
    n = len(points)
    mark = np.zeros(n + 1, bool)
    if n == 0:
        return mark[:0]
    cls = _classes()[points]
    edge = np.zeros(n + 1, bool)      # a text starts or ends here
    edge[first] = True
    run = np.ones(n, bool)
    run[1:] = (cls[1:] != cls[:-1]) | edge[1:-1]
    start = np.flatnonzero(run)
    end = np.append(start[1:], n)
    kind = cls[start]
    mark[start] = True
    # White space before more text gives up its last character: a plain space
    # joins the next piece, any other character stands alone.
    inner = (kind == SPACE) & ~edge[end]
    last = end[inner] - 1
    mark[last] = True
    joins = points[last] == 0x20
    mark[last[joins] + 1] = False
    # A contraction: a lone apostrophe that starts a piece, then its letters.
    lone = start[(kind == OTHER) & (end - start == 1) & ~edge[end]]
    lone = lone[(points[lone] == 0x27) & mark[lone]]
    lone = lone[cls[lone + 1] == LETTER]
    if len(lone):
        a = points[lone + 1]
        has2 = lone + 2 < n
        b = np.where(has2, points[np.minimum(lone + 2, n - 1)], 0)
        b = np.where(has2 & ~edge[np.minimum(lone + 2, n)], b, 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e")))
               | ((a == ord("l")) & (b == ord("l"))))
        for at, length in ((lone[one], 2), (lone[two], 3)):
            mark[at + 1] = False
            mark[at + length] = True
    return mark[:n]


def _code_points(data: np.ndarray, offsets: np.ndarray):
    """Code points of a slice, their byte offsets, and where each row starts."""
    text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    return points, at, np.searchsorted(at, offsets)


def _encode(data: np.ndarray, cut: np.ndarray, vocab: Vocabulary):
    """Ids of the pieces ``data[cut[i]:cut[i+1]]`` and their number per piece."""
    n = len(cut) - 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), n, [
        None, pa.py_buffer(np.ascontiguousarray(cut, np.int64)), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    merged = [vocab.merge(p) for p in coded.dictionary.to_pylist()]
    length = np.array([len(m) for m in merged], np.int64) // 4
    flat = np.frombuffer(b"".join(merged), np.int32)
    begin = np.cumsum(length) - length
    index = coded.indices.to_numpy()
    count = length[index]
    total = int(count.sum())
    shift = np.repeat(begin[index] - (np.cumsum(count) - count), count)
    return flat[shift + np.arange(total)], count


def _list_array(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                    pa.array(ids, pa.int32()))


def _encode_rows(s: K.Slice, vocab: Vocabulary) -> pa.Array:
    points, at, first = _code_points(s.data, s.offsets)
    starts = np.flatnonzero(boundaries(points, first))
    cut = np.append(at[starts], len(s.data))
    ids, count = _encode(s.data, cut, vocab)
    upto = np.concatenate([[0], np.cumsum(count)])
    return _list_array(ids, upto[np.searchsorted(starts, first)])


# -- long texts --------------------------------------------------------------

def _chunk_rows(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                n = -(-len(text) // chunk)
                for k in range(n):
                    a = max(0, k * chunk - overlap)
                    part = text[a:(k + 1) * chunk]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, 1), b.column(1).slice(i, 1),
                         pa.array([k], pa.int32()), pa.array([a], pa.int64()),
                         pa.array([part], pa.string())],
                        names=["doc_id", "text_hash", "k", "start", "part"])
    return run


def _pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each chunk's own piece starts, as if it were a text by itself."""
    for b in batches:
        for s in K.slices(b, "part"):
            points, _, first = _code_points(s.data, s.offsets)
            mark = boundaries(points, first)
            found = [np.flatnonzero(mark[i:j]).astype(np.int32).tobytes()
                     for i, j in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(s.batch.column(i) for i in range(5)), pa.array(found, pa.binary())],
                names=["doc_id", "text_hash", "k", "start", "part", "marks"])


def stitch(chunks: list[tuple[int, str, np.ndarray]]) -> tuple[str, np.ndarray]:
    """Join chunks ``(start, text, local piece starts)`` in order: the whole text
    and its piece starts."""
    start, text, marks = chunks[0]
    done: list[np.ndarray] = []           # settled piece starts
    whole = [text]
    marks = marks.astype(np.int64) + start
    end = start + len(text)
    for start, text, more in chunks[1:]:
        more = more.astype(np.int64) + start
        settled = marks[(marks >= start) & (marks <= end - 3)]
        both = np.intersect1d(settled, more, assume_unique=True)
        whole.append(text[end - start:])
        if len(both):
            p = both[0]
            done.append(marks[marks < p])
            marks = more[more >= p]
        else:
            # No common start: cut again from the last settled one.
            safe = marks[marks <= end - 3]
            p = int(safe[-1]) if len(safe) else int(marks[0])
            done.append(marks[marks < p])
            tail = "".join(whole)[p - (start + len(text)):]
            points = np.frombuffer(tail.encode("utf-32-le"), np.uint32)
            marks = np.flatnonzero(boundaries(points, np.array([0, len(points)]))) + p
        end = start + len(text)
    return "".join(whole), np.concatenate([*done, marks])


# What a caller does with the ids of a batch inside the task: from the ids (a
# list array) and the vocabulary to further columns.
Finish = Callable[[pa.Array, Vocabulary], list[pa.Array]]


def _join_chunks(raw, finish: Finish, names: list[str]):
    def run(t: pa.Table) -> pa.Table:
        vocab = _vocabulary(raw.value)
        t = t.sort_by("k")
        k = t.column("k").to_numpy()
        copies = int((k == 0).sum())
        _, one = np.unique(k, return_index=True)
        parts = t.column("part").take(pa.array(one)).to_pylist()
        starts = t.column("start").to_numpy()[one]
        marks = [np.frombuffer(t.column("marks")[int(i)].as_py(), np.int32) for i in one]
        text, found = stitch(list(zip(starts.tolist(), parts, marks)))
        data = np.frombuffer(text.encode(), np.uint8)
        points, at, _ = _code_points(data, np.array([0, len(data)]))
        ids, _ = _encode(data, np.append(at[found], len(data)), vocab)
        cols = finish(_list_array(ids, np.array([0, len(ids)])), vocab)
        own = t.column("doc_id").combine_chunks().slice(0, 1)
        return pa.table([pa.chunked_array([c] * copies) for c in (own, *cols)], names=names)
    return run


def encode_with(docs: DataFrame, ranks: str, finish: Finish, fields: str,
                text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id`` and the columns ``fields`` that ``finish`` makes of every row's
    ids, in the task that has encoded them (one Python process per task, and
    the ids do not travel). The rank file at the path ``ranks`` is read on the
    driver and sent to the tasks once."""
    spark = docs.sparkSession
    with open(ranks, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    src = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = dict(src.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, {fields}"
    names = StructType.fromDDL(schema).names
    # Bytes bound code points from above and cost no decoding.
    is_long = F.octet_length("text") > chunk

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(raw.value)
        for b in batches:
            for s in K.slices(b, "text"):
                yield pa.RecordBatch.from_arrays(
                    [s.batch.column(0), *finish(_encode_rows(s, vocab), vocab)], names=names)

    whole = src.where(~is_long).mapInArrow(short, schema)
    parts = (src.where(is_long)
             .select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
             .mapInArrow(_chunk_rows(chunk, overlap),
                         f"doc_id {id_type}, text_hash bigint, k int, start bigint, "
                         "part string")
             .repartition("doc_id", "text_hash", "k")
             .mapInArrow(_pre_tokenise,
                         f"doc_id {id_type}, text_hash bigint, k int, start bigint, "
                         "part string, marks binary"))
    joined = parts.groupBy("doc_id", "text_hash").applyInArrow(
        _join_chunks(raw, finish, names), schema)
    return whole.unionByName(joined)


def encode(docs: DataFrame, ranks: str, text: str = "text", chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of every row."""
    return encode_with(docs, ranks, lambda ids, vocab: [ids], "ids array<int>", text,
                       chunk, overlap)


def decode(tokens: DataFrame, ranks: str) -> DataFrame:
    """``tokens`` with ``decoded``: the raw bytes of its ids, back to back."""
    with open(ranks, "rb") as f:
        raw = tokens.sparkSession.sparkContext.broadcast(f.read())
    keep = [f"`{n}` {t}" for n, t in tokens.dtypes]
    names = [*tokens.columns, "decoded"]
    at = tokens.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(raw.value)
        for big in batches:
            for i in range(0, big.num_rows, 256):
                b = big.slice(i, 256)
                out = list(decode_rows(b.column(at), vocab))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())],
                                                 names=names)

    return tokens.mapInArrow(run, ", ".join([*keep, "decoded binary"]))


def decode_rows(ids: pa.Array, vocab: Vocabulary) -> Iterator[bytes]:
    """The raw bytes of every row of a list array (empty for null)."""
    for row in ids:
        yield (decode_ids(row.values.to_numpy(zero_copy_only=False), vocab)
               if row.is_valid else b"")


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    if not len(ids):
        return b""
    taken = vocab.tokens.take(pa.array(ids, pa.int32()))
    off = np.frombuffer(taken.buffers()[1], np.int64)[:len(taken) + 1]
    return taken.buffers()[2][int(off[0]):int(off[-1])].to_pybytes()

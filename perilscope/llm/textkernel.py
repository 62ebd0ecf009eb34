"""Vectorised text kernels used inside Arrow tasks.

Every function works on one *slice* of a string column: the UTF-8 bytes of
its rows back to back plus their offsets. Slices hold a bounded number of
bytes (one row may exceed it, a row is never cut), so a task's memory does
not follow the size of an Arrow batch.

Words are maximal runs of bytes other than ASCII white space (space and
0x09-0x0D). Words, lines and word n-grams are identified by 64-bit hashes. Words
and lines add up a mixed 64-bit value of every byte and its place (a polynomial
over the bytes would give some strings of a few letters the same hash whatever
its base); n-grams are polynomials over the hashes of their words, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 2 << 20
_STEP = 0x9E3779B97F4A7C15
HASH_BYTES = 1 << 17        # bytes hashed at once
_WORD_BASE = 0xC2B2AE3D27D4EB4F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (invertible, avalanching)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U64(b))
            p[0] = U64(1)
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 16 << 20:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


class Prefix:
    """Hashes of any sub-range of a sequence in O(1) per range."""

    def __init__(self, values: np.ndarray, base: int):
        up, self._down = _powers(base, len(values) + 1)
        self._sum = np.zeros(len(values) + 1, U64)
        np.cumsum((values.astype(U64) + U64(1)) * up[:-1], out=self._sum[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start])


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges that rise and do not overlap: the sum over a range of
    ``mix(place << 8 | byte)``, mixed with the length. Works through the data in
    blocks, so a long text needs no more memory than a short one."""
    out = np.zeros(len(start), U64)
    for lo in range(0, len(data), HASH_BYTES):
        hi = min(lo + HASH_BYTES, len(data))
        a, z = np.searchsorted(end, lo, side="right"), np.searchsorted(start, hi, side="left")
        from_, to = np.maximum(start[a:z], lo), np.minimum(end[a:z], hi)
        some = np.flatnonzero(to > from_)
        if not len(some):
            continue
        from_, size = from_[some], (to - from_)[some]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(from_ - first, size)
        place = at - np.repeat(start[a:z][some], size)
        terms = mix(((place.astype(U64) << U64(8)) | data[at]) * U64(_STEP) + U64(_STEP))
        out[a + some] += np.add.reduceat(terms, first)
    return mix(out + (end - start).astype(U64) * U64(_STEP))


class Slice(NamedTuple):
    batch: pa.RecordBatch   # the rows
    data: np.ndarray        # bytes of the text column
    offsets: np.ndarray     # int64, len(rows) + 1


class Words(NamedTuple):
    start: np.ndarray       # byte offsets in the slice
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray       # index of each row's first word, len(rows) + 1


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null reads as empty."""
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = pc.fill_null(col, pa.scalar(b"" if "binary" in str(col.type) else "",
                                          col.type))
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    width = np.int64 if large else np.int32
    o = np.frombuffer(off, width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, text: str,
           max_bytes: int = SLICE_BYTES, lower: bool = False) -> Iterator[Slice]:
    """Cut a batch into slices of at most ``max_bytes`` of text (at least one row)."""
    k = batch.schema.get_field_index(text)
    _, offsets = text_buffers(batch.column(k))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        to = min(n, max(at + 1, to))
        part = batch.slice(at, to - at)
        col = part.column(k)
        data, off = text_buffers(pc.utf8_lower(col) if lower else col)
        yield Slice(part, data, off)
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """All words of a slice, in order."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, U64), np.zeros(len(offsets), np.int64))
    ink = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~ink[:-1]
    start = np.flatnonzero(ink & (before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~ink[1:]
    end = np.flatnonzero(ink & (after | cut[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets, side="left")
    return Words(start, end, row, hash_ranges(data, start, end), first)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``n`` words inside one row, and its first word."""
    if len(w.hash) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.arange(len(w.hash) - n + 1)
    at = at[w.row[at] == w.row[at + n - 1]]
    return Prefix(w.hash, _WORD_BASE).ranges(at, at + n), at


def lines_of(data: np.ndarray, offsets: np.ndarray):
    """``\\n``-split lines of every row: start, end, row, hash."""
    nl = np.flatnonzero(data == 10)
    row_nl = np.searchsorted(offsets, nl, side="right") - 1
    rows = len(offsets) - 1
    start = np.concatenate([offsets[:-1], nl + 1])
    end = np.concatenate([nl, offsets[1:]])
    own = np.concatenate([np.arange(rows), row_nl])
    o = np.lexsort((start, own))
    p = np.lexsort((end, np.concatenate([row_nl, np.arange(rows)])))
    start, end, own = start[o], end[p], own[o]
    return start, end, own, hash_ranges(data, start, end)


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many true bytes each row has."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    if len(keys) == 0:
        return np.zeros(0, bool)
    o = np.argsort(keys, kind="stable")
    s = keys[o]
    same = s[1:] == s[:-1]
    dup = np.zeros(len(keys), bool)
    dup[1:] |= same
    dup[:-1] |= same
    out = np.empty(len(keys), bool)
    out[o] = dup
    return out

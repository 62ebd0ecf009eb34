"""Set-similarity join of texts by chosen paths.

A text is the set of its word 5-grams (lower-cased, split at ASCII white
space; a text of 1-4 words is one shingle of all its words). Texts with equal
sets are one *node*. Nodes are split recursively: in every run a set keeps
each of its shingles with probability ``1 / (threshold * size)`` under a hash
that all sets share, and goes into the bucket of each kept shingle; the path
so far seeds the next choice. Two sets with similarity at or above the
threshold share at least one chosen shingle per step in expectation, so a
bucket of at most ``LIMIT`` nodes is compared by brute force and larger ones
are split again. ``RUNS`` independent runs bring the recall to the target.

Comparing inside a bucket uses 64 minhash bytes per node and a cut so far
below the threshold that a true pair passes it (4 standard deviations). A
bucket that is still too large after that links all its members
to one of them, which loses nothing. The links form groups; inside a group
all sets meet once and are compared exactly, in blocks when it is large, so
every reported link is exact and a pair missed by the buckets is still found
if its texts landed in one group.

Recall of a pair at exactly the threshold: one run finds it with probability
0.63 by one choice and 0.37 by three, so ``RUNS`` = 12 gives at least 0.996;
any higher similarity has more.

Defined results: null or word-free texts have no shingles and link to
nothing; repeated rows and equal sets are one node; a null doc_id is an id
like any other (it sorts first); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import textkernel as K
from .components import connected_components

THRESHOLD = 0.8
SHINGLE = 5
RUNS = 12
LEVELS = 2            # splits: one choice, then SPLIT2 more at once
SPLIT2 = 2
LIMIT = 64            # nodes that a bucket may hold to be brute-forced
SKETCH = 64           # minhash bytes per node
SKETCH_CUT = 0.6
BLOCK = 384           # sets that one exact comparison holds on either side

U64 = np.uint64
_rng = np.random.default_rng(20240501)
_RUN_SEED = _rng.integers(0, 1 << 63, RUNS, dtype=np.uint64)
_STEP_MULT = _rng.integers(0, 1 << 63, 1 + SPLIT2, dtype=np.uint64) | U64(1)
_HASH_MULT = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending, and each row's bounds."""
    rows = len(offsets) - 1
    w = K.words_of(data, offsets)
    count = np.diff(w.first)
    g, at = K.ngrams(w, SHINGLE)
    row = w.row[at]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        a, b = w.first[short], w.first[short + 1]
        g = np.concatenate([g, K.mix(K.Prefix(w.hash, K._WORD_BASE).ranges(a, b)
                                     + (b - a).astype(U64))])
        row = np.concatenate([row, short])
    o = np.lexsort((g, row))
    g, row = g[o], row[o]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(rows + 1))


def _reduce(ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """ufunc over every (non-empty) row."""
    return ufunc.reduceat(values, first[:-1])


def _choose(g, first, limit, path, row, level):
    """One more choice for every path: the kept shingles' paths, their parent
    (index into ``path``) and their row."""
    size = (first[1:] - first[:-1])[row]
    total = int(size.sum())
    parent = np.repeat(np.arange(len(path)), size)
    start = np.cumsum(size) - size
    token = g[np.arange(total) - np.repeat(start - first[:-1][row], size)]
    draw = K.mix(token ^ path[parent]) * _STEP_MULT[level]
    kept = draw <= limit[row][parent]
    parent, draw = parent[kept], draw[kept]
    return K.mix(draw + path[parent]), parent, row[parent]


def _nodes(s: K.Slice):
    """Per row: size, two set fingerprints, sketch, and the paths of all levels."""
    g, first = shingle_sets(s.data, s.offsets)
    size = np.diff(first)
    full = np.flatnonzero(size)
    bounds = np.concatenate([first[full], first[-1:]])
    rows = len(size)
    f1, f2 = np.zeros(rows, U64), np.zeros(rows, U64)
    sketch = np.zeros((rows, SKETCH), np.uint8)
    lists = []
    if len(full):
        f1[full] = _reduce(np.add, K.mix(g ^ U64(0x1234567)), bounds)
        f2[full] = _reduce(np.add, K.mix(g * U64(0x9E3779B97F4A7C15)), bounds)
        for j, m in enumerate(_HASH_MULT):
            low = _reduce(np.minimum, g * m, bounds)
            sketch[full, j] = (K.mix(low) >> U64(40)).astype(np.uint8)
    keep = np.minimum(1.0 / (THRESHOLD * np.maximum(size, 1)), 1.0)
    limit = np.where(keep >= 1.0, U64(2**64 - 1),
                     (np.minimum(keep, 0.999999) * 2.0**64).astype(U64))
    if len(full):
        # The first split needs no expansion by path: every run sees all shingles.
        owner = np.repeat(np.arange(rows), size)
        paths, owners = [], []
        for seed in _RUN_SEED:
            draw = K.mix(g ^ seed) * _STEP_MULT[0]
            kept = draw <= limit[owner]
            paths.append(K.mix(draw[kept] + seed))
            owners.append(owner[kept])
        path, row = np.concatenate(paths), np.concatenate(owners)
    else:
        path, row = np.zeros(0, U64), np.zeros(0, np.int64)
    o = np.argsort(row, kind="stable")
    path, row = path[o], row[o]
    lists.append((path, row, None))
    # The second split takes SPLIT2 more choices at once, below each first path.
    root = path
    for level in range(1, 1 + SPLIT2):
        step = max(1, (4 << 20) // max(1, int(size.max(initial=1))))
        got = [_choose(g, first, limit, path[i:i + step], row[i:i + step], level)
               for i in range(0, len(path), step)]
        if not got:
            break
        up = np.concatenate([x[1] + i * step for i, x in enumerate(got)])
        path, row = np.concatenate([x[0] for x in got]), np.concatenate([x[2] for x in got])
        root = root[up]
    lists.append((path, row, root))
    return size, f1, f2, sketch, lists


def _listed(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    off = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64)))


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in K.slices(b, "__text", lower=True):
            size, f1, f2, sketch, lists = _nodes(s)
            rows = len(size)
            cols = [s.batch.column(0), s.batch.column(1), pa.array(size.astype(np.int64)),
                    pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                    pa.array([x.tobytes() for x in sketch], pa.binary())]
            names = ["doc_id", "text_hash", "size", "f1", "f2", "sketch"]
            for level, (path, row, parent) in enumerate(lists, 1):
                cols.append(_listed(path, row, rows))
                names.append(f"p{level}")
                if parent is not None:
                    cols.append(_listed(parent, row, rows))
                    names.append(f"q{level}")
            yield pa.RecordBatch.from_arrays(cols, names=names)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside buckets; rows come sorted by bucket."""
    for path, nodes, size, sketch in _groups(batches):
        a, b = _sketch_links(nodes, size, sketch)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _groups(batches):
    held: list[tuple] = []
    for b in batches:
        cols = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(),
                np.frombuffer(b.column(3).cast(pa.binary(SKETCH)).buffers()[1], np.uint8)
                [b.column(3).offset * SKETCH:][:len(b) * SKETCH].reshape(-1, SKETCH)
                if len(b) else np.zeros((0, SKETCH), np.uint8))
        if held:
            cols = tuple(np.concatenate([h, c]) for h, c in zip(held[0], cols))
            held = []
        path = cols[0]
        if not len(path):
            continue
        cut = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1])
        for i, j in zip(cut[:-1], cut[1:]):
            yield path[i], cols[1][i:j], cols[2][i:j], cols[3][i:j]
        held = [tuple(c[cut[-1]:] for c in cols)]
    if held:
        yield held[0][0][0], *held[0][1:]


def _sketch_links(nodes, size, sketch):
    """A spanning forest of the bucket's likely pairs."""
    n = len(nodes)
    if n == 2:
        lo, hi = min(size), max(size)
        near = (sketch[0] == sketch[1]).mean() >= SKETCH_CUT and lo >= THRESHOLD * hi
        return (nodes[:1], nodes[1:]) if near and nodes[0] != nodes[1] else ((), ())
    same = (sketch[:, None, :] == sketch[None, :, :]).mean(axis=2) >= SKETCH_CUT
    same &= size[:, None] >= THRESHOLD * size[None, :]
    same &= same.T
    return _spanning(nodes, same)


def _spanning(nodes, linked):
    """Star edges (least member, member) of the components of a 0/1 matrix."""
    label = np.arange(len(nodes))
    while True:
        low = np.where(linked, label[None, :], len(nodes)).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[label[off]], nodes[off]


_CELL = "node bigint, copies bigint, size bigint, tokens binary"


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle set of each row, if the row has its node's fingerprints."""
    for b in batches:
        for s in K.slices(b, "__text", lower=True):
            g, first = shingle_sets(s.data, s.offsets)
            keep = np.array([s.batch.column("size")[i].as_py() == first[i + 1] - first[i]
                             for i in range(len(first) - 1)], bool)
            at = np.flatnonzero(keep)
            part = s.batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [part.column("cell"), part.column("side"), part.column("grid"),
                 part.column("node"), part.column("copies"),
                 pa.array([g[first[i]:first[i + 1]].tobytes() for i in at], pa.binary())],
                names=["cell", "side", "grid", "node", "copies", "tokens"])


_PAIR_SCHEMA = "node bigint, links bigint, root bigint, other bigint"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links inside cells; rows come sorted by cell."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        cell = t.column("cell").to_numpy()
        if not len(cell):
            continue
        cut = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
        for i, j in zip(cut[:-1], cut[1:]):
            yield from _cell(t.slice(i, j - i))
        held = t.slice(cut[-1])
    if held is not None:
        yield from _cell(held)


def _cell(t: pa.Table) -> Iterator[pa.RecordBatch]:
    node = t.column("node").to_numpy()
    side = t.column("side").to_numpy()
    grid = t.column("grid").to_numpy()[0]
    _, one = np.unique(np.stack([node, side]), axis=1, return_index=True)
    node, side = node[one], side[one]
    copies = t.column("copies").to_numpy()[one]
    tokens = t.column("tokens").to_pylist()
    sets = [np.frombuffer(tokens[i], U64) for i in one]
    size = np.array([len(x) for x in sets], np.int64)
    vocab, col, seen = np.unique(np.concatenate(sets), return_inverse=True,
                                 return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = seen[col] > 1          # a shingle of one set adds to no overlap
    rank = np.cumsum(seen > 1) - 1
    row, col, width = row[shared], rank[col[shared]], int((seen > 1).sum())
    left = np.flatnonzero(side == 0) if grid == 2 else np.arange(len(sets))
    right = np.flatnonzero(side == 1) if grid == 2 else left
    overlap = np.zeros((len(left), len(right)), np.float32)
    place = np.full(len(sets), -1)
    for lo in range(0, width, 4096):
        use = (col >= lo) & (col < lo + 4096)
        m = np.zeros((len(sets), min(4096, width - lo)), np.float32)
        m[row[use], col[use] - lo] = 1
        overlap += m[left] @ m[right].T
    del place
    union = size[left][:, None] + size[right][None, :] - overlap
    linked = overlap >= THRESHOLD * union - 1e-6 * union
    linked &= node[left][:, None] != node[right][None, :]
    links_left = linked @ copies[right]
    nodes, links = node[left], links_left
    if grid == 2:
        nodes = np.concatenate([nodes, node[right]])
        links = np.concatenate([links, linked.T @ copies[left]])
        square = np.zeros((len(nodes), len(nodes)), bool)
        square[:len(left), len(left):] = linked
        square |= square.T
    else:
        square = linked
    a, b = _spanning(nodes, square)
    if grid == 0:       # the whole group is here: the roots are final
        root = nodes.copy()
        at = {int(x): i for i, x in enumerate(nodes)}
        for x, y in zip(a, b):
            root[at[int(y)]] = x
        other = pa.nulls(len(nodes), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes), pa.array(links.astype(np.int64)), pa.array(root), other],
            names=["node", "links", "root", "other"])
    else:
        none = pa.nulls(len(nodes), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes), pa.array(links.astype(np.int64)), none, none],
            names=["node", "links", "root", "other"])
        if len(a):
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(np.zeros(len(a), np.int64)),
                 pa.nulls(len(a), pa.int64()), pa.array(b)],
                names=["node", "links", "root", "other"])


def _sorted_map(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(fn, schema)


def _candidates(nodes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` whose groups hold every pair above the threshold."""
    leaves, stars, hot = [], [], None
    for level in range(1, LEVELS + 1):
        if level == 1:
            rows = nodes.select("node", F.explode("p1").alias("path"))
        else:
            rows = (nodes.select("node", F.explode(F.arrays_zip(
                        F.col(f"p{level}").alias("path"), F.col(f"q{level}").alias("up")))
                        .alias("x")).select("node", "x.path", "x.up"))
            rows = stage(rows.join(hot.withColumnRenamed("path", "up"), "up", "left_semi"
                                   ).select("node", "path"), f"paths-{level}-rows")
        count = stage(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"),
                                               F.min("node").alias("low"))
                      .where("n > 1"), f"paths-{level}")
        hot = count.where(F.col("n") > LIMIT).select("path")
        leaves.append(rows.join(count.where(F.col("n") <= LIMIT).select("path"), "path",
                                "left_semi"))
        if level == LEVELS:
            stars.append(rows.join(count.where(F.col("n") > LIMIT), "path")
                         .select(F.col("low").alias("a"), F.col("node").alias("b")))
    members = leaves[0]
    for x in leaves[1:]:
        members = members.unionByName(x)
    rows = (members.join(nodes.select("node", "size", "sketch"), "node")
            .select("path", "node", "size", "sketch"))
    edges = _sorted_map(rows, "path", _bucket_edges, "a bigint, b bigint")
    return edges.unionByName(stars[0]).where("a <> b")


def jaccard_join(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_hash``, ``class_id`` (least
    doc_id of the near-duplicate class), ``copy_id`` (least doc_id with the same
    shingle set), ``n_links`` (documents at or above the threshold) and
    ``first_of_class``, true for the rows of the class's first text."""
    src = docs.select("doc_id", F.xxhash64(F.col(text)).alias("text_hash"),
                      F.col(text).alias("__text"))
    id_type = dict(src.dtypes)["doc_id"]
    paths = ", ".join(f"p{i} array<bigint>" + (f", q{i} array<bigint>" if i > 1 else "")
                      for i in range(1, LEVELS + 1))
    found = stage(src.mapInArrow(
        _node_rows, f"doc_id {id_type}, text_hash bigint, size bigint, f1 bigint, "
        f"f2 bigint, sketch binary, {paths}"), "join-sets")
    found = found.withColumn("node", F.xxhash64("size", "f1", "f2"))
    ids = found.select("doc_id", "text_hash", "size", "node")
    big = ["size", "sketch", *(f"p{i}" for i in range(1, LEVELS + 1)),
           *(f"q{i}" for i in range(2, LEVELS + 1))]
    nodes = stage(found.where("size > 0").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        *[F.first(c).alias(c) for c in big]), "join-nodes")
    groups = connected_components(_candidates(nodes), "join-groups")
    # Cells: a small group is one; a large one is cut into blocks, and every
    # pair of blocks is a cell.
    many = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("bigint")
    # A block meets itself and later ones as the left side, earlier ones as the right.
    placed = (groups.join(many, "component")
              .join(nodes.select("node", "rep", "copies", "size"), "node")
              .withColumn("n_blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
              .withColumn("meet", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                       F.col("n_blocks") - 1)))
              .select("node", "rep", "copies", "size",
                      F.xxhash64("component", F.least("block", "meet"),
                                 F.greatest("block", "meet")).alias("cell"),
                      F.when(F.col("meet") >= F.col("block"), 0).otherwise(1).alias("side"),
                      F.when(F.col("n_blocks") == 1, 0)
                      .when(F.col("meet") == F.col("block"), 1)
                      .otherwise(2).alias("grid")))
    texts = src.where(F.col("__text").isNotNull())
    sets = (texts.join(placed, texts["doc_id"].eqNullSafe(placed["rep.doc_id"])
                       & (texts["text_hash"] == placed["rep.text_hash"]))
            .select("cell", "side", "grid", "node", "copies", "size", "__text")
            .mapInArrow(_set_rows, "cell bigint, side int, grid int, node bigint, "
                                   "copies bigint, tokens binary"))
    exact = stage(_sorted_map(sets, "cell", _compare, _PAIR_SCHEMA), "join-exact")
    links = exact.groupBy("node").agg(F.sum("links").alias("links"),
                                      F.min("root").alias("root"))
    across = exact.where("other is not null").select(F.col("node").alias("a"),
                                                     F.col("other").alias("b"))
    if across.isEmpty():
        rooted = links.withColumn("root", F.coalesce("root", "node"))
    else:
        wide = connected_components(across, "join-classes")
        rooted = (links.join(wide, "node", "left")
                  .select("node", "links", F.coalesce("component", "root", "node")
                          .alias("root")))
    per_node = (nodes.select("node", "rep", "copies").join(rooted, "node", "left")
                .select("node", "rep", "copies", F.coalesce("root", "node").alias("root"),
                        F.coalesce("links", F.lit(0)).alias("links")))
    per_node = stage(per_node, "join-result")
    roots = per_node.groupBy("root").agg(F.min("rep").alias("first"))
    per_node = per_node.join(roots, "root")
    out = ids.join(per_node, "node", "left")
    return out.select(
        "doc_id", "text_hash",
        F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
        .alias("class_id"),
        F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id"))
        .alias("copy_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.when(F.col("rep").isNull(), True).otherwise(
            F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
            & (F.col("text_hash") == F.col("first.text_hash"))).alias("first_of_class"))

"""Repair of conversation structure by depth-first branch-and-bound.

A conversation's rows are edited until their role initials read
``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (3), Delete (4), Insert an
empty user or assistant turn (3); a truncated row that stays adds 3, blank and
duplicate rows must go. The result is the cheapest edit script, of equal ones the
least in ASCII order of its initials.

The search runs on *pieces* of at most ``PIECE`` rows. It walks depth first with
an explicit stack over nodes (rows done, state of the role grammar), the most
promising child first; a suffix lower bound (what the remaining rows cost at
least) cuts nodes that cannot beat the incumbent (cost, audit), and a dominance
table per node cuts prefixes that are no better than one seen there, until the
stack is empty and the optimum proved. A
piece is solved for every state it may be entered in and returns the best script
per state it can be left in, so a long conversation is solved in parallel, piece
by piece; a fold over its pieces then picks the cheapest chain. Prefixes that meet
in a node hold equally many row edits, so none is a prefix of another and the
ASCII order of whole scripts is decided by their first difference.

Only narrow rows (ids, role, digest of the text, fault) take part in the search;
texts travel once, to the tasks that render the repaired conversation. Those read
a conversation's rows in order and hold one Arrow batch, its audit (one character
a row) and a running digest, never the conversation. Equal rows of a turn are one
narrow row with a count.

Defined results of odd input: a null role or text reads as one space; rows of a
null ``conv_id`` are one conversation; rows sort by turn (null first), then role,
then SHA-256 of the text; an empty role is no role of the grammar; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 256
TURNS = 1024            # turn numbers that are dealt together
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

# The role grammar: states none (0), system (1), user (2), assistant (3).
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SPOKEN = {0: "user", 1: "user", 2: "assistant", 3: "user"}    # who may speak next
TURN = {0: 2, 1: 2, 2: 3, 3: 2}                               # the state after that
TAIL = {0: "", 1: "II", 2: "I", 3: ""}                        # inserts that end it


# -- the search on one piece -----------------------------------------------------------

def _edits(symbol: str, state: int):
    """``(initial, cost, next state)`` of the edits of a row.

    A symbol is a role initial (``o``: any other), upper case where the row is
    truncated, or ``x`` for a run of rows that must go (its cost is added by the
    caller)."""
    if symbol == "x":
        return [("D", 0, state)]
    more = TRUNCATED if symbol.isupper() else 0
    out = [("D", DELETE, state), ("R", REROLE + more, TURN[state])]
    to = NEXT.get((state, symbol.lower()))
    if to is not None:
        out.append(("K", KEEP + more, to))
    return out


def _bounds(symbols: str, leave: int) -> list[list[float]]:
    """Suffix lower bounds: what the rows from ``k`` on cost at least, from each
    state to ``leave``, whatever their audit."""
    out = [[0 if s == leave else math.inf for s in range(4)]]
    for symbol in reversed(symbols):
        now = [min(price + out[-1][to] for _, price, to in _edits(symbol, s)) for s in range(4)]
        for _ in range(2):      # two inserts reach every state that inserts can reach
            now = [min(now[s], INSERT + now[TURN[s]]) for s in range(4)]
        out.append(now)
    return out[::-1]


def _search(symbols: str, entry: int, leave: int):
    """The best ``(cost, audit)`` of a piece from ``entry`` to ``leave``, or None."""
    n, bound = len(symbols), _bounds(symbols, leave)
    best = None
    seen: list[dict] = [{} for _ in range(n + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        least = cost + bound[at][state]
        if least == math.inf or seen[at].get(state, (math.inf,)) <= (cost, audit):
            continue
        if best is not None and (least, audit) > (best[0], best[1][:len(audit)]):
            continue
        seen[at][state] = (cost, audit)
        if at == n:
            best = (cost, audit)
            continue
        children = [(at, TURN[state], cost + INSERT, audit + "I")] + [
            (at + 1, to, cost + price, audit + initial)
            for initial, price, to in _edits(symbols[at], state)]
        # The most promising child is on top of the stack.
        children.sort(key=lambda c: (c[2] + bound[c[0]][c[1]], c[3]), reverse=True)
        stack += children
    return best


@functools.lru_cache(maxsize=20_000)
def solve(symbols: str, entry: int) -> tuple:
    """Per exit state the best ``(cost, audit)`` of a piece entered in ``entry``
    (None where it cannot end). Runs of ``x`` cost nothing and give one ``D``."""
    return tuple(_search(symbols, entry, leave) for leave in range(4))


# -- faults and pieces ----------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: the rows of a damaged copy of the table;
    crc32 of ``conv_id:turn`` modulo 20 drops a row (0), empties its text (1),
    removes its sentence ends (2), repeats it (3) or makes it the user's (4)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    text = blank("text")
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(blank("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
        .alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("bigint").alias("n"), kind.alias("kind"),
    ).where("kind <> 0").drop("kind")


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def faults(rows: DataFrame) -> DataFrame:
    """Narrow rows ``conv_id, turn, role, n, blank, truncated, repeated``, one per
    turn, role and text with its count ``n``; ``repeated``: said in an earlier turn."""
    end = F.right(_trimmed(F.col("text")), F.lit(1))
    said = (rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("said"), "n",
                        (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"))
            .groupBy("conv_id", "turn", "role", "said")
            .agg(F.sum("n").alias("n"), F.max("blank").alias("blank"),
                 F.max("truncated").alias("truncated")))
    again = (said.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"),
                          F.col("said").alias("s"))
             .agg(F.count(F.lit(1)).alias("turns"), F.min(F.struct("turn")).alias("first"))
             .where("turns > 1").select("c", "r", "s", "first"))
    return (said.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                      & (F.col("said") == F.col("s")), "left")
            .withColumn("repeated", F.col("first").isNotNull()
                        & ~F.col("turn").eqNullSafe(F.col("first.turn")))
            .drop("c", "r", "s", "first"))


def _dealt(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions(*by, *order)


def _bucket() -> Column:
    """Rises with the turn; a long conversation has many."""
    return F.expr(f"turn div {TURNS}")


PIECES = pa.schema([("conv_id", pa.int64()), ("bucket", pa.int64()), ("seq", pa.int64()),
                    ("symbols", pa.string()), ("runs", pa.list_(pa.int64())),
                    ("first", pa.string()), ("last", pa.string()),
                    ("counts", pa.list_(pa.int64())), ("least", pa.int64()),
                    ("most", pa.int64()), ("costs", pa.list_(pa.int64())),
                    ("audits", pa.list_(pa.string()))])
PIECES_DDL = ("conv_id bigint, bucket bigint, seq bigint, symbols string, runs array<bigint>, "
              "first string, last string, counts array<bigint>, least bigint, most bigint, "
              "costs array<bigint>, audits array<string>")


class _Piece:
    """Rows of one conversation and bucket on their way to a piece."""

    def __init__(self, conv, bucket, seq: int, turn):
        self.key, self.seq, self.turn = (conv, bucket), seq, turn
        self.symbols, self.runs, self.initials = [], [], [None, None]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None

    def gone(self, n: int) -> None:
        """``n`` rows that must be deleted."""
        if n and self.symbols and self.symbols[-1] == "x":
            self.runs[-1] += n
        elif n:
            self.symbols.append("x")
            self.runs.append(n)

    def add(self, turn, role, n, blank, truncated, repeated, new_turn) -> None:
        initial = role[:1]
        if self.initials[0] is None:
            self.initials[0] = initial
        else:
            self.illegal += self.initials[1] + initial not in LEGAL
        self.illegal += (n - 1) * (initial + initial not in LEGAL)
        self.initials[1] = initial
        if turn is not None and new_turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        if blank:
            self.blank += n
            self.gone(n)
        elif repeated:
            self.duplicate += n
            self.gone(n)
        else:
            symbol = initial if initial in ("s", "u", "a") else "o"
            self.truncated += truncated
            self.symbols.append(symbol.upper() if truncated else symbol)
            self.duplicate += n - 1
            self.gone(n - 1)

    def row(self) -> tuple:
        symbols = "".join(self.symbols)
        paths = [p for entry in range(4) for p in solve(symbols, entry)]
        return (*self.key, self.seq, symbols, self.runs, *self.initials,
                [self.blank, self.duplicate, self.truncated, self.illegal, self.turns],
                self.least, self.most, [p and p[0] for p in paths], [p and p[1] for p in paths])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _pieces(size: int):
    def run(batches):
        piece, turn, out = None, None, []
        for b in batches:
            for conv, bucket, at, role, n, blank, truncated, repeated in zip(
                    *(b[c].to_pylist() for c in ("conv_id", "bucket", "turn", "role", "n",
                                                 "blank", "truncated", "repeated"))):
                same = piece is not None and piece.key == (conv, bucket)
                new_turn = not same or at != turn
                if piece is None or not same or len(piece.symbols) >= size:
                    if piece is not None:
                        out.append(piece.row())
                    piece = _Piece(conv, bucket, piece.seq + 1 if same else 0, at)
                piece.add(at, role, n, blank, truncated, repeated, new_turn)
                turn = at
            yield _batch(out, PIECES)
            out = []
        if piece is not None:
            yield _batch([piece.row()], PIECES)
    return run


# -- the chain of pieces ------------------------------------------------------------------------

CHAIN = pa.schema([("conv_id", pa.int64()), ("bucket", pa.int64()), ("seq", pa.int64()),
                   ("ops", pa.string()), ("totals", pa.list_(pa.int64()))])
CHAIN_DDL = "conv_id bigint, bucket bigint, seq bigint, ops string, totals array<bigint>"


def _expand(audit: str, symbols: str, runs: list[int]) -> str:
    """An audit of a piece with a ``D`` for every row of its runs."""
    out, row, run = [], 0, 0
    for op in audit:
        if op == "I":
            out.append(op)
            continue
        if symbols[row] == "x":
            out.append("D" * runs[run])
            run += 1
        else:
            out.append(op)
        row += 1
    return "".join(out)


class _Chain:
    """The cheapest chain through a conversation's pieces.

    Per state the chain is entered in: cost and rank of its audit among the
    chains of the four states. The rank stands for the text of the audit."""

    def __init__(self, conv):
        self.conv, self.at, self.links = conv, {0: (0, 0)}, []
        self.counts, self.least, self.most, self.last = [0] * 5, None, None, None
        self.forced = 0

    def add(self, bucket, seq, symbols, runs, first, last, counts, least, most, costs, audits):
        best: dict[int, tuple] = {}
        for entry, (cost, rank) in self.at.items():
            for leave in range(4):
                more = costs[4 * entry + leave]
                if more is not None:
                    found = (cost + more, rank, audits[4 * entry + leave], entry)
                    best[leave] = min(best.get(leave, found), found)
        order = sorted(best, key=lambda s: best[s][1:3])
        self.at = {s: (best[s][0], order.index(s)) for s in best}
        self.links.append((bucket, seq, symbols, runs,
                           {s: (best[s][3], best[s][2]) for s in best}))
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if self.last is not None:
            self.counts[3] += self.last + first not in LEGAL
        self.last = last
        self.least = least if self.least is None else min(self.least, least or self.least)
        self.most = most if self.most is None else max(self.most, most or self.most)
        self.forced += sum(runs)

    def rows(self):
        _, _, state = min((cost + INSERT * len(TAIL[s]), rank, s)
                          for s, (cost, rank) in self.at.items())
        cost = self.at[state][0] + INSERT * len(TAIL[state]) + DELETE * self.forced
        ops, path = TAIL[state], []
        for bucket, seq, symbols, runs, came in reversed(self.links):
            state, audit = came[state]
            path.append((self.conv, bucket, seq, _expand(audit, symbols, runs) + ops, None))
            ops = ""
        blank, duplicate, truncated, illegal, turns = self.counts
        gaps = 0 if self.least is None else self.most - self.least + 1 - turns
        totals = [min(gaps, 2 ** 63 - 1), blank, duplicate, truncated, illegal, cost]
        path[-1] = (*path[-1][:4], totals)
        return reversed(path)


def _chains(batches):
    chain, out = None, []
    for b in batches:
        for conv, *piece in zip(*(c.to_pylist() for c in b.columns)):
            if chain is None or chain.conv != conv:
                if chain is not None:
                    out.extend(chain.rows())
                chain = _Chain(conv)
            chain.add(*piece)
        yield _batch(out, CHAIN)
        out = []
    if chain is not None:
        yield _batch(list(chain.rows()), CHAIN)


# -- the repaired conversation ----------------------------------------------------------------------

REPAIRED = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", pa.string()), ("repaired_sha256", pa.string())])
REPAIRED_DDL = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
                "illegal bigint, cost bigint, audit string, repaired_sha256 string")


class Renderer:
    """Applies the edits of a conversation to its rows, in order: ``line`` is
    called with every line of the repaired conversation."""

    def __init__(self, line):
        self.line, self.state, self.ops, self.at = line, 0, "", 0

    def inserts(self) -> None:
        while self.at < len(self.ops) and self.ops[self.at] == "I":
            self.speak("")
            self.at += 1

    def speak(self, text: str) -> None:
        self.line(f"{SPOKEN[self.state]}:{text}")
        self.state = TURN[self.state]

    def row(self, role: str, text: str) -> None:
        self.inserts()
        op = self.ops[self.at]
        self.at += 1
        if op == "K":
            self.line(f"{role}:{text}")
            self.state = NEXT[self.state, role[:1]]
        elif op == "R":
            self.speak(text)

    def more(self, ops: str) -> None:
        self.inserts()
        self.ops, self.at = self.ops[self.at:] + ops, 0


class _Conversation:
    def __init__(self, conv):
        self.conv, self.totals, self.audit, self.lines = conv, [0] * 6, [], 0
        self.sha, self.renderer = hashlib.sha256(), Renderer(self.line)

    def line(self, text: str) -> None:
        if self.lines:
            self.sha.update(b"\n")
        self.sha.update(text.encode())
        self.lines += 1

    def add(self, kind, ops, totals, role, text, n) -> None:
        if kind == 0:
            self.totals = totals or self.totals
            self.audit.append(ops)
            self.renderer.more(ops)
        elif kind == 1:
            for _ in range(n):
                self.renderer.row(role, text)

    def row(self) -> tuple:
        self.renderer.inserts()
        return (self.conv, *self.totals, "".join(self.audit), self.sha.hexdigest())


def _render(batches):
    conv, out = None, []
    for b in batches:
        for key, *part in zip(*(b[c].to_pylist() for c in (
                "conv_id", "kind", "ops", "totals", "role", "text", "n"))):
            if conv is None or conv.conv != key:
                if conv is not None:
                    out.append(conv.row())
                conv = _Conversation(key)
            conv.add(*part)
        yield _batch(out, REPAIRED)
        out = []
    if conv is not None:
        yield _batch([conv.row()], REPAIRED)


def repair(rows: DataFrame, conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """Repairs ``rows`` (``conv_id, turn, role, text, n``; ``n``: how often a row
    stands there). One row per ``conv_id`` of ``conversations``, also without any
    row: faults found, cost and audit of the cheapest edits, digest of the result."""
    narrow = _dealt(faults(rows).withColumn("bucket", _bucket()), ["conv_id", "bucket"],
                    ["turn", "role", "said"])
    pieces = narrow.mapInArrow(_pieces(piece), PIECES_DDL)
    chain = _dealt(pieces, ["conv_id"], ["bucket", "seq"]).mapInArrow(_chains, CHAIN_DDL)
    null = lambda kind: F.lit(None).cast(kind)
    # A conversation's mark, then per bucket its edits before its rows.
    marks = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    parts = (chain.withColumn("kind", F.lit(0)).unionByName(
        rows.select("conv_id", _bucket().alias("bucket"), F.lit(1).alias("kind"), "turn", "role",
                    _digest(F.col("text")).alias("said"), "text", "n"), allowMissingColumns=True)
        .unionByName(marks.select("conv_id", null("bigint").alias("bucket"),
                                  F.lit(-1).alias("kind")), allowMissingColumns=True))
    return _dealt(parts, ["conv_id"], ["bucket", "kind", "seq", "turn", "role", "said"]
                  ).mapInArrow(_render, REPAIRED_DDL)

"""Hard negatives, conversation repair and the embedding join against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope.llm import conversation_repair as R
from perilscope.llm import embedding_join as E
from perilscope.llm import hard_negatives as N

VECTORS = "vec_id bigint, embedding array<double>, label int, q string, v string, node int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], VECTORS).repartition(4)


# -- hard negatives ----------------------------------------------------------------

def negatives(rows, every, k=5, m=3):
    """Brute force over ``(vec_id, vector, label)``."""
    own = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(
                x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        own[i] = min(own.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in own.items():
        if a % every:
            continue
        score = lambda i: max(-2 ** 56, min(2 ** 56, sum(
            x * y for x, y in zip(q, own[i][1]))))
        ranked = sorted((-score(i), i) for i in own if i != a)
        for p, positive in [x for x in ranked if own[x[1]][0] == label][:k]:
            fit = [(s, i) for s, i in ranked if own[i][0] != label
                   and 50 * -p <= 100 * -s <= 95 * -p][:m]
            out += [(a, positive, r + 1, i, -p, -s) for r, (s, i) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every):
    usable = N.usable(vectors(spark, rows), "vec_id", "embedding", F.col("label"))
    return sorted(tuple(r) for r in N.mine(usable, F.col("vec_id") % every == 0).collect())


def odd_vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], rng.randrange(3)) for i in range(160)]
    rows += [(200 + i, rows[5][1], i % 3) for i in range(9)]           # ties
    rows += [(300, None, 1), (301, [0.1, None], 1), (302, [float("nan")] * 6, 0),
             (303, [float("inf")] * 6, 0), (304, [0.5] * 6, None), (None, [0.5] * 6, 1),
             (305, [], 1), (306, [0.4, 0.4], 2), (310, [0.0] * 6, 0), rows[7],
             (8, [0.9] * 6, 2)]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = odd_vectors()
    got, want = mined(spark, rows, 5), negatives(rows, 5)
    assert got == want and len(want) > 100


@pytest.mark.parametrize("scale", [3e3, 1e6, 1e30])
def test_hard_negatives_of_large_components(spark, scale):
    """Fields wider than half a double's significand are Python integers."""
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, scale) for _ in range(4)], rng.randrange(2)) for i in range(40)]
    if scale == 1e30:       # the components themselves are held at a long's ends
        got = mined(spark, rows, 4)
        assert all(abs(s) <= N.BOUND for r in got for s in r[4:])
    else:
        assert mined(spark, rows, 4) == negatives(rows, 4)


def test_hard_negatives_of_nothing(spark):
    assert mined(spark, [], 5) == []


@pytest.mark.parametrize("top", [1, 100, 2 ** 20, 2 ** 62])
def test_packed_scores_are_exact(top):
    rng = random.Random(top)
    a = np.array([[rng.randint(-top, top) for _ in range(9)] for _ in range(5)])
    c = np.array([[rng.randint(-top, top) for _ in range(9)] for _ in range(13)])
    want = np.clip(a.astype(object) @ c.T.astype(object), -N.BOUND, N.BOUND)
    assert (N.scorer(c)(a) == want).all()


# -- the embedding join ----------------------------------------------------------------

def linked(rows, threshold):
    """Per row of ``(vec_id, vector)``: ``(vec_id, links, component, kept)``."""
    def sound(v):
        return v is not None and any(x for x in v) and all(
            x is not None and math.isfinite(x) for x in v)

    def cosine(a, b):
        a, b = [x / max(map(abs, a)) for x in a], [x / max(map(abs, b)) for x in b]
        return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(
            math.fsum(x * x for x in a) * math.fsum(x * x for x in b))

    n = len(rows)
    near = [[j for j in range(n) if i != j and sound(rows[i][1]) and sound(rows[j][1])
             and len(rows[i][1]) == len(rows[j][1])
             and cosine(rows[i][1], rows[j][1]) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def near_vectors(seed=1, groups=12, d=8):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [rng.gauss(0, 1) for _ in range(d)]
        for _ in range(rng.randrange(1, 9)):
            rows.append([x + rng.gauss(0, 0.12) for x in base])
    chain = [[math.cos(0.3 * k), math.sin(0.3 * k)] + [0.0] * (d - 2) for k in range(12)]
    rows += chain + [rows[0]] * 5 + [[3 * x for x in rows[1]], [1e-200 * x for x in rows[1]],
                                     [1e200 * x for x in rows[1]], [-x for x in rows[1]]]
    rows += [None, [], [0.0] * d, [None] * d, [1.0, None] + [0.0] * (d - 2), [float("nan")] * d,
             [float("inf")] + [0.0] * (d - 1), [1.0, 2.0], [1.0, 2.01], [2.0]]
    rows = [(7 * k % 1009, v) for k, v in enumerate(rows)]
    return rows + [rows[2], (None, rows[3][1]), (None, None), (None, [5.0, 5.0, 5.0])]


@pytest.mark.parametrize("interval,leaf", [(2048, 128), (7, 2), (1, 1)])
def test_embedding_join_equals_brute_force(spark, monkeypatch, interval, leaf):
    monkeypatch.setattr(E.cell_links, "__defaults__", (leaf,))
    rows = near_vectors()
    df = vectors(spark, [(i, v, 0) for i, v in rows])
    got = E.near_duplicates(df, threshold=0.95, interval=interval).collect()
    want = linked(rows, 0.95)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert sum(w[1] for w in want) > 50


def test_embedding_join_skips_distant_intervals(spark):
    """Boxes that are apart give no pair; what remains holds every link."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) + rng.gauss(0, .01), rng.gauss(0, .01)], 0)
            for i in range(64)]
    nodes = vectors(spark, rows).select(F.col("vec_id").alias("node"),
                                        F.col("embedding").alias("v"), F.lit(1).alias("weight"))
    nodes = nodes.withColumn("weight", F.col("weight").cast("bigint"))
    radius = math.sqrt(0.1)
    placed = E.sequence(nodes, E.principal(nodes), radius)
    assert sorted(r.pos for r in placed.collect()) == list(range(64))
    pairs = {(r.a, r.b) for r in E.interval_pairs(placed, radius, 8, 2).collect()}
    assert len(pairs) < 36 and {(k, k) for k in range(8)} <= pairs


def test_embedding_join_of_nothing(spark):
    assert E.near_duplicates(vectors(spark, [])).count() == 0
    only = E.near_duplicates(vectors(spark, [(3, None, 0)])).collect()
    assert [tuple(r) for r in only] == [(3, 0, 3, True)]


def test_values_at_the_threshold_are_summed_exactly():
    a = np.array([[1.0, 0.0]])
    b = np.array([[0.95, math.sqrt(1 - 0.95 ** 2)]])
    hit = E._linked(E.unit(a), E.unit(b), a, b, E._exact(a[0], b[0]))
    assert hit.all()


# -- conversation repair ------------------------------------------------------------------

def hurt(rows):
    out = []
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def repaired(rows):
    """Uniform-cost search over one conversation's rows after damage."""
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(r[3])))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not ink else "duplicate" if (role, text) in seen
                     else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            break
        if (at, state) in done:
            continue
        done.add((at, state))
        for who in ("user", "assistant"):
            to = step.get((state, who[0]))
            if to:
                heapq.heappush(heap, (cost + 3, audit + "I", at, to, (*lines, f"{who}:")))
                if at < len(rows) and kinds[at] in ("", "truncated"):
                    heapq.heappush(heap, (cost + 3 + 3 * (kinds[at] != ""), audit + "R", at + 1,
                                          to, (*lines, f"{who}:{rows[at][3]}")))
        if at < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, lines))
            to = step.get((state, rows[at][2][:1]))
            if to and kinds[at] in ("", "truncated"):
                heapq.heappush(heap, (cost + 3 * (kinds[at] != ""), audit + "K", at + 1, to,
                                      (*lines, f"{rows[at][2]}:{rows[at][3]}")))
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    rng = random.Random(11)
    says = ["Yes.", "No!", "What?", "so it goes", "Well, yes. ", "", " \t\x0b\r", "a?b", None,
            "é.", "x" * 300 + "."]
    roles = ["user", "assistant"] * 5 + ["system", "tool", None, "", "User", "s"]
    rows = []
    for conv in range(120):
        turn = 0
        for k in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])):
            role = "user" if k % 2 == 0 else "assistant"
            text = f"{conv} {k} is so{rng.choice(['.', '!', '', ' ?  '])}"
            if rng.random() < 0.35:
                role, text = rng.choice(roles), rng.choice(says)
            rows.append((conv, turn, role, text))
            turn += rng.choice([1, 1, 1, 1, 0, 3, 1500])
        if rng.random() < 0.2:
            rows.append((conv, None, "system", "Be good."))
    rows += [(None, 1, "user", "Who?"), (None, None, None, None), rows[3], rows[3]]
    rows += [(900, k, ("user", "assistant")[k // 2 % 2], f"{k % 50} there.") for k in range(400)]
    rows += [(901, k, "assistant", "same.") for k in range(30)]
    return rows


@pytest.fixture(scope="module")
def chats():
    return conversations()


@pytest.mark.parametrize("piece", [256, 1, 3])
def test_repair_equals_brute_force(spark, chats, piece):
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in chats],
                               "conv_id bigint, turn bigint, role string, text string, n int, "
                               "said string, kind int").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in R.repair(R.damaged(df), df, piece).collect()}
    whole = hurt(chats)
    want = {c: repaired([r for r in whole if r[0] == c]) for c in {r[0] for r in chats}}
    assert got == want
    assert any(w[5] == 0 and w[6] == "" for w in want.values())        # nothing left


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert R.repair(R.damaged(df), df).count() == 0


def test_bound_and_dominance_lose_nothing():
    """Every string of up to five symbols, from every state, against all scripts."""
    rng = random.Random(4)

    def scripts(symbols, state):
        if not symbols:
            yield 0, "", state
            return
        for lead in range(3):
            at = state
            for _ in range(lead):
                at = R.TURN[at]
            for op, price, to in R._edits(symbols[0], at):
                for cost, rest, end in scripts(symbols[1:], to):
                    yield 3 * lead + price + cost, "I" * lead + op + rest, end

    for _ in range(150):
        symbols = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(5)))
        for entry in range(4):
            best = [None] * 4
            for cost, audit, end in scripts(symbols, entry):
                if best[end] is None or (cost, audit) < best[end]:
                    best[end] = (cost, audit)
            assert list(R.solve(symbols, entry)) == best

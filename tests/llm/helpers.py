"""Brute-force versions of the corpus operators, and small fixtures."""

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def twins(n):
    """Two different strings of ``2 ** n`` letters whose polynomials over the bytes
    agree modulo 2**64, whatever their odd base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def corpus():
    """Documents with copies, near copies, shared passages, odd and missing texts."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(40, 160), 5000) for _ in range(30)]
    passage = prose(rng, 60, 5000)
    texts += [prose(rng, 30, 5000) + " " + passage + " " + prose(rng, 30, 5000)
              for _ in range(6)]
    base = prose(rng, 200, 5000).split()
    for k in range(8):
        near = list(base)
        near[20 * k + 3] = f"changed{k}"
        texts.append(" ".join(near))
    texts += [texts[0]] * 3 + [texts[5] + "\n", "", None, None, "one", "one", "two words",
                               "two  words", "same " * 300, "same " * 301, "\n\n \t",
                               "éé ßß 中文 " * 30, "x" * 5000]
    one, two = twins(10)
    texts += [f"{one}\n{two}\n{one}", f"{prose(rng, 60, 5000)} {one}",
              " ".join([*texts[7].split()[:30], one, *texts[7].split()[30:]]),
              " ".join([*texts[7].split()[:30], two, *texts[7].split()[30:]])]
    rows = [(i * 3, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[1])                     # a repeated row
    rows.append((None, texts[2], "de", None, None))
    return rows


def shingles(text, n=5):
    w = WORD.findall((text or "").lower())
    if not w:
        return frozenset()
    if len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def jaccard_classes(rows, threshold=0.8):
    """Per row: (class id, copy id, links)."""
    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    order = lambda k: (rows[k][0] is not None, rows[k][0] or 0)
    label = list(range(n))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    links = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                    links[i] += 1
                    label[find(i)] = find(j)
    out = []
    for i in range(n):
        if not sets[i]:
            out.append((rows[i][0], rows[i][0], 0))
            continue
        group = [k for k in range(n) if find(k) == find(i)]
        copies = [k for k in group if sets[k] == sets[i]]
        out.append((rows[min(group, key=order)][0], rows[min(copies, key=order)][0], links[i]))
    return out


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))


def repeated_spans(rows, n=50):
    words = [WORD.findall(r[1] or "") for r in rows]
    own = {}
    for k, w in enumerate(words):
        for i in range(len(w) - n + 1):
            own.setdefault(tuple(w[i:i + n]), set()).add(k)
    out = []
    for w in words:
        cover = [False] * (len(w) + 1)
        for i in range(len(w) - n + 1):
            if len(own[tuple(w[i:i + n])]) > 1:
                cover[i:i + n] = [True] * n
        spans, start = [], None
        for i, c in enumerate(cover):
            if c and start is None:
                start = i
            elif not c and start is not None:
                spans.append((start, i))
                start = None
        out.append(spans)
    return out


def order(row):
    return tuple((x is not None, str(x)) for x in row)

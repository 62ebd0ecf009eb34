"""Near duplicates, repeated passages and quality rules against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope.llm import components, jaccard_join, quality_rules, suffix_dedup
from perilscope.llm import textkernel as K

from . import helpers as H


@pytest.fixture(scope="module")
def rows():
    return H.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, H.DOCS).repartition(5)
    # Extra columns whose names the operators use themselves.
    return df.select("*", F.lit("x").alias("size"), F.lit(1).alias("node"),
                     F.lit(1).alias("n_words"), F.lit(2).alias("text_hash"),
                     F.lit(3).alias("kept"), F.lit(4).alias("spans"))


def test_jaccard_join_equals_brute_force(docs, rows):
    got = jaccard_join.jaccard_join(docs).collect()
    want = [(r[0], *x) for r, x in zip(rows, H.jaccard_classes(rows))]
    assert sorted([(r.doc_id, r.class_id, r.copy_id, r.n_links) for r in got], key=H.order) \
        == sorted(want, key=H.order)


def test_jaccard_join_blocks_and_deep_splits(docs, rows, monkeypatch):
    """Small limits: every bucket is split, large groups are compared in blocks."""
    monkeypatch.setattr(jaccard_join, "LIMIT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    got = jaccard_join.jaccard_join(docs).collect()
    want = [(r[0], *x) for r, x in zip(rows, H.jaccard_classes(rows))]
    assert sorted([(r.doc_id, r.class_id, r.copy_id, r.n_links) for r in got], key=H.order) \
        == sorted(want, key=H.order)


def test_one_text_of_each_class_is_first(docs):
    got = jaccard_join.jaccard_join(docs).where("first_of_class and class_id is not null")
    per = got.groupBy("class_id").agg(F.countDistinct("text_hash").alias("n")).collect()
    assert all(r.n == 1 for r in per)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_join(spark.createDataFrame([], H.DOCS)).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 101), (7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 105: 100}


@pytest.mark.parametrize("hot", [50_000, 0])
def test_repeated_passages_equal_brute_force(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = suffix_dedup.repeated_passages(docs).collect()
    want = [(r[0], str(s), sum(b - a for a, b in s))
            for r, s in zip(rows, H.repeated_spans(rows))]
    assert sorted([(r.doc_id, str([(s.start, s.end) for s in r.spans]), r.n_repeated)
                   for r in got], key=H.order) == sorted(want, key=H.order)
    assert any(s for _, s, _ in want)


def test_repeated_passages_of_nothing(spark):
    assert suffix_dedup.repeated_passages(spark.createDataFrame([], H.DOCS)).count() == 0


def test_measures_equal_brute_force(docs, rows):
    got = quality_rules.measure(docs, ["doc_id"]).collect()
    assert sorted([tuple(r[:6]) for r in got], key=H.order) == sorted(
        [(r[0], *H.measures(r[1])) for r in rows], key=H.order)


@pytest.mark.parametrize("block", [1 << 17, 5, 1])
def test_range_hashes_tell_strings_apart(monkeypatch, block):
    """Equal where the bytes are equal, also across the blocks they are read in."""
    monkeypatch.setattr(K, "HASH_BYTES", block)
    words = [w.encode() for w in (*H.twins(6), *H.twins(10), "a", "aa", "ab", "ba", "é", "a")]
    data = np.frombuffer(b" ".join(words), np.uint8)
    got = K.words_of(data, np.array([0, len(data)])).hash.tolist()
    assert len(got) == len(words)
    assert [[a == b for b in got] for a in got] == [[a == b for b in words] for a in words]


def test_no_labels_no_cutoffs(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality_rules.quality_rules(docs, labels).collect()
    assert all(r.kept == (not r.base_failed) for r in got)
    assert all(r.base_failed for r in got if r.n_words < 50)


def test_cutoffs_hold_the_risk(spark):
    """Bad texts full of symbols go; the cutoff rejects few good ones, and a
    stratum with too few labels gets none."""
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", 1) for i in range(600)]
    bad = [(1000 + i, " ".join(f"w{i}x{j}%%%" for j in range(60)), "en", 0) for i in range(50)]
    few = [(2000 + i, t, "de", q) for i, (_, t, _, q) in enumerate(good[:20] + bad[:20])]
    rows = good + bad + few
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows],
                                   "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(df, labels).collect()}
    assert all(got[r[0]] for r in good) and not any(got[r[0]] for r in bad)
    assert all(got[r[0]] for r in few)


def test_binomial_tail_is_exact(spark):
    from math import comb
    df = spark.createDataFrame([(k, n) for n in (1, 20, 300) for k in range(0, min(n, 9))],
                               "k bigint, n bigint")
    p = 0.03
    for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), p)
                       .alias("t")).collect():
        want = 1.0 if r.k > r.n * p else sum(
            comb(r.n, i) * p ** i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.t - want) < 1e-9

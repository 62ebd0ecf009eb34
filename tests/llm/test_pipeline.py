"""The pipeline's stages on a small corpus, and the SQL of the corpus queries."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from perilscope.llm.oracle import ORACLE
from perilscope.llm.queries import QUERIES
from perilscope.session import stage

from . import helpers as H

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """A small copy of the layout: documents, labels and benchmark."""
    import random
    rng = random.Random(21)
    item = H.prose(rng, 40, 5000)
    good = [H.prose(rng, 120, 5000) for _ in range(20)]
    texts = good + [good[0], good[1] + " extra", "short text", None, "", "same " * 100,
                    H.prose(rng, 60, 5000) + " " + item,
                    H.prose(rng, 80, 5000) + ' token = "0123456789abcdef0123" end']
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[2])
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, H.DOCS).withColumn("kept", F.lit("clash")).write.parquet(
        f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)],
                          "doc_id bigint, quality int, toxic int").write.parquet(
        f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        f"{d}/benchmark.parquet")
    return d, rows


def test_stages(spark, inputs):
    d, rows = inputs
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = {}
    for name, fn in P.STAGES[:-1]:
        docs = stage(fn(spark, docs, d), "test")
        assert docs.columns == P.COLUMNS
        ids[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert ids["quality rules"] == sorted([*range(22), 2, 26, 27])
    assert ids["n-gram jaccard join"] == sorted([*range(20), 26, 27])
    assert ids["benchmark decontamination"] == sorted([*range(20), 27])
    assert ids["secret scans"] == sorted([*range(20), 27])
    text = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert text[27][0].endswith(" [SECRET]\" end") and text[27][1] == len(text[27][0])
    assert all(text[i][0] == rows[i][1] for i in range(20))
    last = P.run(spark, d).collect()
    assert sorted(r.doc_id for r in last) == ids["secret scans"]
    assert P.STAGES[-1][1](spark, docs.limit(0), d).count() == 0


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.execute(ORACLE[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    want = [tuple(norm(r[cols.index(c)]) for c in df.columns) for r in rel.fetchall()]
    got = [tuple(norm(v) for v in r) for r in df.collect()]
    assert sorted(got, key=H.order) == sorted(want, key=H.order)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_returns_every_document(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()

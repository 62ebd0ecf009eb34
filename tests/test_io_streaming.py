"""Readers, writers, read_or_build and the streaming re-expressions."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from perilscope.plans import builders as B
from perilscope.session import cluster_conf, stage
from perilscope.sources import io as IO
from perilscope.sources.schema import measure_schema
from perilscope.streaming import incremental as ST


def _tmp():
    return tempfile.mkdtemp(prefix="perilscope-test-", dir="/tmp")


def test_read_measure_renames_and_nan_to_null(spark):
    d = _tmp()
    path = os.path.join(d, "affected.csv")
    with open(path, "w") as fh:
        fh.write("Country name,Year,Total number of people affected by drought per 100,000\n")
    # the value header contains a comma: write it quoted
    with open(path, "w") as fh:
        fh.write('Country name,Year,"Total number of people affected by drought per 100,000"\n')
        fh.write("A,2000,1.5\nB,2001,NaN\nC,,2.0\n")
    df = IO.read_measure(spark, path, "Country name", "Year",
                         "Total number of people affected by drought per 100,000",
                         "affected")
    got = {r["country"]: (r["year"], r["affected"]) for r in df.collect()}
    assert df.columns == ["country", "year", "affected"]
    assert got == {"A": (2000, 1.5), "B": (2001, None), "C": (None, 2.0)}


def test_wide_damage_and_drop_if_exists(spark):
    d = _tmp()
    path = os.path.join(d, "economic_damage.csv")
    with open(path, "w") as fh:
        fh.write("Entity,Code,Year,drought,flood,storm,extreme_temp\n")
        fh.write("A,AAA,2000,1.0,,3.0,\n")
    df = IO.read_wide_damage(spark, path, ["drought", "flood", "storm", "extreme_temp"])
    r = df.first()
    assert (r["Entity"], r["Year"], r["drought"], r["flood"]) == ("A", 2000, 1.0, None)
    assert IO.drop_if_exists(df.withColumn("Unnamed: 0", F.lit(1)), "Unnamed: 0",
                             "absent").columns == df.columns


def test_read_or_build_builds_once_then_reads(spark):
    d = _tmp()
    paths = {"t": os.path.join(d, "t")}
    calls = []

    def build():
        calls.append(1)
        return {"t": spark.range(5).withColumn("x", F.col("id") * 2)}
    first = IO.read_or_build(spark, paths, build)["t"]
    second = IO.read_or_build(spark, paths, build)["t"]
    assert len(calls) == 1
    assert sorted(r["x"] for r in first.collect()) == sorted(r["x"] for r in second.collect())
    with pytest.raises(FileNotFoundError):
        IO.read_or_build(spark, {"t": os.path.join(d, "missing")}, None)


def _publish(spark, out, value, names=("a", "b"), **options):
    paths = {k: os.path.join(out, k) for k in names}
    return IO.read_or_build(spark, paths, lambda: {k: spark.range(1).withColumn(
        "v", F.lit(value)) for k in names}, **options)


def _values(tables):
    return {k: t.first()["v"] for k, t in tables.items()}


def test_artefacts_appear_together_or_not_at_all(spark, monkeypatch):
    """A crash between the two writes leaves the former pair, never a mixed one."""
    out = _tmp()
    _publish(spark, out, 1)
    write, written = IO.write_table, []

    def crash(df, path, **options):
        if written:
            raise RuntimeError("lost")
        written.append(path)
        write(df, path, **options)
    monkeypatch.setattr(IO, "write_table", crash)
    with pytest.raises(RuntimeError):
        _publish(spark, out, 2, use_cache=False)
    monkeypatch.setattr(IO, "write_table", write)
    assert _values(_publish(spark, out, 3)) == {"a": 1, "b": 1}
    # Before anything was published, a crash publishes nothing.
    fresh = _tmp()
    written.clear()
    monkeypatch.setattr(IO, "write_table", crash)
    with pytest.raises(RuntimeError):
        _publish(spark, fresh, 4)
    monkeypatch.setattr(IO, "write_table", write)
    assert _values(_publish(spark, fresh, 5)) == {"a": 5, "b": 5}


def test_changed_inputs_are_built_again(spark):
    out, source = _tmp(), os.path.join(_tmp(), "in")
    spark.range(3).write.parquet(source)
    mark = lambda *p: IO.fingerprint([spark.read.parquet(source)], p)
    first = mark(1)
    assert first == mark(1) != mark(2)
    assert _values(_publish(spark, out, 1, inputs=first)) == {"a": 1, "b": 1}
    assert _values(_publish(spark, out, 2, inputs=mark(1))) == {"a": 1, "b": 1}
    spark.range(9).write.mode("append").parquet(source)
    assert mark(1) != first
    assert _values(_publish(spark, out, 3, inputs=mark(1))) == {"a": 3, "b": 3}
    # The build before the published one stays readable, older ones go.
    _publish(spark, out, 4, use_cache=False)
    assert len(os.listdir(os.path.join(out, "a"))) == 2


def test_unreadable_lines_are_kept_apart(spark):
    d = _tmp()
    path = os.path.join(d, "m.csv")
    with open(path, "w") as fh:
        fh.write("Country name,Year,x\nA,2000,1.5\nA,200x,2\nB,2001,1;5\nC,2002\n"
                 "D,2003,1,2\nE,2004,\n\"F, f\",2005,NaN\n")
    schema = measure_schema("Country name", "Year", "x")
    rows, rejects = IO.read_checked(spark, path, schema, {"Country name": "country"})
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("A", 2000, 1.5), ("E", 2004, None), ("F, f", 2005, None)]
    got = {r["line"]: r["reason"] for r in rejects.collect()}
    assert got == {"A,200x,2": "Year", "B,2001,1;5": "x", "C,2002": "x", "D,2003,1,2": "fields"}
    counts = {r["reason"]: r["rejected"] for r in IO.reject_counts(rejects).collect()}
    assert counts == {"Year": 1, "x": 2, "fields": 1}


def test_streaming_totals_equal_batch(spark):
    rows = [("A", 2000, "flood", 1.0, 2.0), ("A", 2001, "flood", None, 1.0),
            ("B", 2000, "drought", 3.0, None), ("A", 2000, "drought", 5.0, 1.0)]
    df = spark.createDataFrame(rows, "country string, year int, hazard string, "
                                     "affected double, death double")
    src = stage(df.repartition(3), "stream-src")
    path = src.inputFiles()[0].rsplit("/", 1)[0]
    stream = ST.read_stream(spark, path, src, max_files=1)
    paths = ST.stream_paths(spark, "test-totals")
    ST.run_available(ST.totals_stream(stream, period_size=5), paths["out"],
                     paths["checkpoint"])
    got = sorted(tuple(r) for r in spark.read.parquet(paths["out"]).collect())
    exp = sorted(tuple(r) for r in B.hazard_total(df, period_size=5).collect())
    assert got == exp


def test_rebuild_on_arrival(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    src = stage(df.repartition(4), "stream-raw")
    path = src.inputFiles()[0].rsplit("/", 1)[0]
    paths = ST.stream_paths(spark, "test-rebuild")
    ST.rebuild_on_arrival(ST.read_stream(spark, path, src, max_files=1), paths["raw"],
                          paths["out"], lambda all_: all_.groupBy("k").count(),
                          paths["checkpoint"])
    got = {r["k"]: r["count"] for r in spark.read.parquet(paths["out"]).collect()}
    assert got == {0: 4, 1: 3, 2: 3}


def test_cluster_conf_sizes():
    conf = cluster_conf(100 * 2 ** 40, checkpoint_dir="hdfs:///x")
    assert conf["spark.checkpoint.dir"] == "hdfs:///x"
    assert int(conf["spark.sql.shuffle.partitions"]) == 102_400   # a quarter of the input in 256 MB parts
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"

"""End-to-end jobs over files."""

import json
import os
import tempfile

from perilscope import queries as Q
from perilscope.plans import jobs as JB
from perilscope.sources import driver_tables as D

SF = "/root/testdata/sf0.01"


def test_raw_paths_json_roundtrip(spark):
    raw = Q.write_raw_files(spark, D.order_facts(spark, "/root/testdata/sf0.001", "sparse"))
    d = tempfile.mkdtemp(prefix="perilscope-job-", dir="/tmp")
    p = os.path.join(d, "raw.json")
    with open(p, "w") as fh:
        json.dump({k: getattr(raw, k) for k in ("per_capita_affected", "per_capita_death",
                                                 "total_affected", "total_deaths", "damage")}, fh)
    again = JB.RawPaths.from_json(p)
    assert again.damage == raw.damage and again.total_deaths == raw.total_deaths
    table = JB.build_analysis(spark, again)
    assert table.count() > 0
    totals = JB.build_totals(spark, again)
    assert "total_affected" in totals.columns and totals.count() > 0


def test_train_and_predict_then_cached(spark):
    f = D.order_facts(spark, SF, "dense")
    analysis = Q.analysis(spark, SF, "dense")
    out = tempfile.mkdtemp(prefix="perilscope-train-", dir="/tmp")
    first = JB.train_and_predict(spark, analysis, out, cutoff=1999, lo=1998, hi=2001,
                                 n_iter=1, excluded=D.EXCLUDED_NATIONS)
    second = JB.train_and_predict(spark, analysis, out, cutoff=1999, lo=1998, hi=2001,
                                  n_iter=1, excluded=D.EXCLUDED_NATIONS)
    assert first["predictions"].count() == second["predictions"].count() > 0
    assert second["importance"].count() == 18
    totals = JB.B.totals_table(JB.B.merge_totals(JB.B.hazard_total(D.measures_long(f))))
    views = JB.page_views(analysis, totals, second["predictions"], second["importance"])
    assert views["top20"].count() <= 20 and views["hazard_share"].count() > 0
    assert views["ranked_scores"].count() >= views["top20"].count()


def test_unfinished_artefacts_are_rebuilt(spark):
    from perilscope.sources import io as IO
    out = tempfile.mkdtemp(prefix="perilscope-io-", dir="/tmp")
    paths = {"a": f"{out}/a", "b": f"{out}/b"}
    built = []

    def build():
        built.append(1)
        return {k: spark.range(3) for k in paths}

    IO.read_or_build(spark, paths, build)
    IO.read_or_build(spark, paths, build)
    assert len(built) == 1
    version, = os.listdir(f"{out}/b")
    os.unlink(f"{out}/b/{version}/_SUCCESS")    # as after a crash in the write
    assert IO.read_or_build(spark, paths, build)["b"].count() == 3
    assert len(built) == 2

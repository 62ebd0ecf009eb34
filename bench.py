"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line. Each query is forced to
completion with the ``noop`` sink (full computation, no driver collect).
Every query runs once untimed (JVM start-up, JIT and code generation for
its plan shapes), then once timed: the figures are steady-state times.
Nothing is cached between the two runs (staged tables get fresh paths).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "analysis_set_yearly",
    "analysis_set_binned",
    "hazard_impact_yearly",
    "totals_table",
    "damage_yearly",
    "feature_table",
    "composite_index",
    "score_latest",
    "ranked_scores",
    "period_ranking",
    "dominant_hazard",
    "hazard_share",
    "rank_global",
    "rolling_trend5",
    "column_median",
    "describe",
    "forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from perilscope.queries import QUERIES, forget_searches
    from perilscope.session import drop_stages, local_session
    # BENCH_EVENT_LOG=<scratch folder> writes Spark's event log for stage times.
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          event_log=os.environ.get("BENCH_EVENT_LOG"))
    times = {}
    for name in names:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        forget_searches()
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else None}))
    drop_stages(spark)
    spark.stop()


if __name__ == "__main__":
    main()

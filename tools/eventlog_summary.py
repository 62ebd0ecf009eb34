"""Summarise a Spark event log written to a scratch folder (e.g. by
``BENCH_EVENT_LOG=<dir> python bench.py``): jobs, stages, total stage time
and the slowest stages. Reads plain or zstd-compressed logs.

Usage: python tools/eventlog_summary.py <event-log dir or file> [top]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    with open(path, "rb") as fh:
        data = fh.read()
    if path.endswith(".zstd"):
        import zstandard
        data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
    return data.decode(errors="replace").splitlines()


def main() -> None:
    target = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    files = ([target] if os.path.isfile(target)
             else sorted(glob.glob(os.path.join(target, "**", "events_*"), recursive=True)
                         + glob.glob(os.path.join(target, "*.zstd"))))
    jobs, stages = 0, []
    for f in files:
        for line in _lines(f):
            try:
                e = json.loads(line)
            except ValueError:
                continue
            kind = e.get("Event")
            if kind == "SparkListenerJobStart":
                jobs += 1
            elif kind == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                if si.get("Submission Time") and si.get("Completion Time"):
                    stages.append((si["Completion Time"] - si["Submission Time"],
                                   si["Number of Tasks"], si["Stage Name"][:80]))
    print(f"jobs={jobs} stages={len(stages)} stage_ms={sum(s[0] for s in stages)}")
    for ms, tasks, name in sorted(stages, reverse=True)[:top]:
        print(f"{ms:7d} ms {tasks:5d} tasks  {name}")


if __name__ == "__main__":
    main()

"""Count shuffles, single-partition exchanges, nested-loop joins, Cartesian
products, windows and scans in the physical plans of registered queries.

Usage: python tools/plan_audit.py [sf_dir] name ...
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "shuffles": r"Exchange (?:hashpartitioning|rangepartitioning|RoundRobin)",
    "single": r"Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "bnlj": r"BroadcastNestedLoopJoin",
    "cartesian": r"CartesianProduct",
    "windows": r"\bWindow\b",
    "scans": r"FileScan",
}


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    from perilscope.queries import QUERIES
    from perilscope.session import local_session
    spark = local_session(8)
    for name in args or sorted(QUERIES):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        lines = plan.splitlines()
        unbounded = [lines[i + 1].strip()[:90] for i, ln in enumerate(lines)
                     if "Exchange SinglePartition" in ln and i + 1 < len(lines)
                     and "keys=[]" not in lines[i + 1] and "partial_" not in lines[i + 1]]
        print(name, " ".join(f"{k}={v}" for k, v in counts.items()),
              ("| single-partition over: " + "; ".join(unbounded)) if unbounded else "")


if __name__ == "__main__":
    main()

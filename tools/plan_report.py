"""Summarise the physical plans of registered queries (run on a small fixture).

usage: python tools/plan_report.py [sf_dir] [name ...]
Prints per query: exchanges by kind, join strategies, windows, Python nodes and
what each scan reads.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from epiframe.registry import QUERIES  # noqa: E402
from epiframe.session import build_session  # noqa: E402

KINDS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct", "Window", "MapInArrow", "MapInPandas", "ArrowEvalPython",
         "BatchEvalPython", "Generate", "InMemoryTableScan"]


def summary(plan: str) -> dict:
    out = {k: plan.count(k) for k in KINDS if plan.count(k)}
    ex = re.findall(r"Exchange (\w+)(?:\(([^)]*)\))?", plan)
    out["exchanges"] = [f"{k}({a.split(',')[0]})" if a else k for k, a in ex]
    out["scans"] = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)))
    out["pushed"] = sorted(set(p for p in re.findall(r"PushedFilters: (\[[^\]]*\])", plan) if p != "[]"))
    out["partition_filters"] = sorted(set(p for p in re.findall(r"PartitionFilters: (\[[^\]]*\])", plan)
                                          if p != "[]"))
    return out


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    names = [a for a in args if not a.startswith("/")] or list(QUERIES)
    spark = build_session("local[4]")
    for name in names:
        df = QUERIES[name](spark, sf)
        s = summary(df._jdf.queryExecution().executedPlan().toString())
        print(f"## {name}")
        for k, v in s.items():
            if v:
                print(f"  {k}: {v}")


if __name__ == "__main__":
    main()

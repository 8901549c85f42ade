"""Time the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default the headline set), BENCH_WARM_DIR
     (untimed warm-up fixture, default /root/testdata/sf0.001).
Each query is run to completion through Spark's ``noop`` sink (the whole plan
executes, nothing is collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "assemble17", "assemble18", "encode_slots", "attach_codes", "one_hot",
    "split_pos", "sample_hash", "downsample_negatives", "balanced_batches",
    "sequential_batches", "roc_auc", "eval_by_sample", "masked_score", "eval_model",
    "read_labelled3",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    from epiframe.registry import QUERIES
    from epiframe.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                          extra={"spark.driver.memory": "16g"})
    # warm-up (not timed): every timed query once on the smallest fixture, so
    # JVM code paths, generated code and Python workers are ready
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for warm in names:
        QUERIES[warm](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

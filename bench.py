"""Time the headline queries and print one JSON line.

Each query is run once to warm the JVM and then timed; the result is written to the no-op sink, so every
column of every row is computed."""

from __future__ import annotations

import json
import os
import sys
import time

from lineweave.plans import QUERIES
from lineweave.session import local_session

HEADLINE = [
    "degree_map", "branch_ratio", "dilate_disk", "open_close", "components", "fill_holes", "radius_join", "greedy_match", "nms",
    "radius_clusters", "class_metrics", "calibrated_fractions", "vote", "synthesis_filter", "cluster_arbitrate", "interval",
    "threshold_sweep", "stretch", "ring_angles", "crossing_number", "local_junction", "ring_arms",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        if name not in QUERIES:
            continue
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

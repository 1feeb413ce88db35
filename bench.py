"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and then ``BENCH_RUNS`` times (default 3) into Spark's no-op sink;
the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from packetloom.plans.registry import QUERIES  # noqa: E402
from packetloom.session import build_session  # noqa: E402

HEADLINE = [
    "protocol_breakdown", "top_talkers_bytes", "traffic_totals", "dns_summary", "inter_arrival", "flows_capture",
    "flows_live", "port_scan", "scaled_features", "flow_anomaly_report", "capture_summary", "session_gaps",
    "dissect", "chunks_text", "tfidf_topk", "dense_topk",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(folder).name, "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()

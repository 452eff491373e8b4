"""Time the headline queries on local cores and print one JSON line.

Each query runs once unmeasured, to compile, and then ``BENCH_RUNS`` times; the median
counts. Results go to the no-op sink, so every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans import QUERIES
from tidemark.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))

HEADLINE = (
    "stg_customers",
    "training_set",
    "mart_customer_features",
    "quality_report",
    "constraint_tests",
    "business_metrics",
    "segment_distributions",
    "population_summary",
    "insights",
    "customer_360",
    "rfm_scores",
    "binary_metrics",
    "profit_threshold",
    "lift_top_decile",
    "chrono_split",
    "ab_report",
    "sequential_looks",
    "data_drift",
    "event_state",
    "online_features",
    "reengagement",
    "mask_pii",
    "guardrails",
    "doc_tokens",
    "rag_topk",
    "vector_topk",
    "bgnbd_loglik",
    "clv_tiers",
    "coupon_campaign",
    "crm_tasks",
)


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    times = {}
    for name in names:
        run(spark, name)
        times[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/"))
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

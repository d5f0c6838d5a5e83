"""Time the headline queries and print one JSON line.

Each query is run once to warm up and then three times; the median counts.
Results are computed in full and discarded by Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "overall_churn", "churn_by_contract", "churn_by_tenure_band", "top_churned_customers",
    "mrr_snapshot", "mrr_by_contract", "mrr_series", "revenue_concentration",
    "cohort_retention", "retention_matrix", "revenue_retention",
    "customer_months", "mrr_from_customer_months", "monthly_mrr", "mrr_decomposition",
    "nrr_orders", "nrr_by_contract", "nrr_events",
    "naive_clv", "survival_curves", "customer_value", "churn_reduction_sensitivity",
    "feature_table", "feature_drift_open", "evaluate_score", "analyze_experiment",
    "describe_columns", "value_summary", "cox_hazard_ratios", "store_upsert", "stream_windows",
    "logistic_model",
]


def run(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from ebbline.plans import catalog
    from ebbline.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    seconds = {}
    for name in HEADLINE:
        query = catalog.QUERIES[name]
        run(spark, query, sf_dir)
        seconds[name] = round(statistics.median(run(spark, query, sf_dir) for _ in range(repeats)), 4)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()

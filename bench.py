"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the timed runs after one
warm-up, ``BENCH_QUERIES`` a comma list of queries instead of the headline ones. A query's time is the
median run, plan building included; sweeps run once. Rows go to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from kohorta.plans.queries import QUERIES
from kohorta.session import local_session

HEADLINE = [
    "flatten_visits",
    "sex_evidence",
    "map_codes",
    "relational_to_records",
    "history_carry",
    "target_labels",
    "wide_pivot",
    "to_wide",
    "to_yearly",
    "visit_validity",
    "cohort_classify",
    "cohort_select",
    "cohort_attrition",
    "tableone_full",
    "correlation_pairs",
    "calinski_harabasz",
    "silhouette_exact",
    "silhouette_sq",
    "kmeans_fit",
    "best_k_silhouette",
    "best_k_elbow",
    "dbscan",
]
#: Dozens of models each: one run after the others, no warm-up.
SWEEPS = ["best_k_gap", "aic_bic_sweep", "evaluate_k", "evaluate_k_ward", "candidate_ks"]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    times = {}
    for name in names.split(",") if names else HEADLINE + SWEEPS:
        if name in SWEEPS:
            times[name] = round(run(spark, name, sf_dir), 3)
            continue
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

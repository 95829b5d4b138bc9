"""Time the headline queries; prints one JSON line.

Each query runs three times into a sink that keeps nothing.  Its figure is the
better of the second and third run; the first, with a cold JVM, is listed too.
"""

from __future__ import annotations

import json
import os
import time

from verification import queries
from verification.compare import session

HEADLINES = [
    "cluster_profile",
    "cluster_category_preference",
    "cluster_price_band",
    "cluster_month_delta",
    "pearson_matrix",
    "spearman_matrix",
    "price_elasticity",
    "hhi_by_city",
    "pareto_projects",
    "institution_risk",
    "city_similarity",
    "by_city",
    "top_projects",
    "cluster_top_projects",
    "cluster_doctor_matching",
    "trend_report",
    "clean",
    "kmeans_cluster",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    known = queries.build()
    best, first = {}, {}
    for name in HEADLINES:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - start, 3))
        first[name], best[name] = runs[0], min(runs[1:])
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "first_run": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

Every query runs twice after a short warm-up: ``cold`` is the first run, ``queries`` the second, ``value``
the sum of the second runs. A run builds the plan, including whatever it checkpoints, and computes every
row and column of the result. BENCH_MODEL=0 leaves out training and scoring of the forest.
"""

from __future__ import annotations

import json
import os
import time

from catalog.queries import queries
from millwright.session import local_session

HEADLINE = [
    "production_summary", "kpi_summary", "machine_performance", "shift_analysis", "monthly_trend",
    "department_analysis", "product_analysis", "sales_by_product", "machine_mean_rates", "machine_shift_pivot",
    "department_losses", "revenue_by_region", "maintenance_cost_by_type", "machine_bands", "revenue_lost_bands",
    "month_trend", "best_worst_picks", "worst_runs", "enriched_production", "derived_metrics",
    "correlation_factors", "correlation_matrix", "describe_stats", "trend_line_fit", "shift_boxplot",
    "rate_histogram", "high_defect_label", "confusion_matrix", "dq_orphans", "surrogate_key", "insights",
]
MODEL = ["feature_importance", "score_production", "model_accuracy"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()

    def seconds(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds("table_counts")
    names = HEADLINE + ([] if os.environ.get("BENCH_MODEL") == "0" else MODEL)
    cold = {name: seconds(name) for name in names}
    warm = {name: seconds(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

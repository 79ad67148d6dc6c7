"""Time the headline queries and print one JSON line.

Facts are read from ``$BENCH_SF_DIR``. ``customer_base`` builds the customer table from
the facts; the queries after it start from that table, cached, as they would from a
stored one. Every query is written to the no-op sink, so all its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from valuegrain.plans.queries import QUERIES  # noqa: E402
from valuegrain.plans.workspace import workspace  # noqa: E402
from valuegrain.session import local_session  # noqa: E402

HEADLINE = (
    "customer_base",
    "training_base",
    "quality_numeric",
    "quality_overview",
    "validation_split",
    "clean_customers",
    "rfm_scores",
    "rfm_segment_summary",
    "features_behavioral",
    "features_temporal",
    "features_statistical",
    "features_acquisition",
    "features_interaction",
    "features_holiday",
    "heuristic_scores",
    "customers_page",
    "top_customers",
    "segment_summary",
    "dashboard_kpis",
    "value_histogram",
    "audiences",
    "budget_allocation",
    "temporal_split_rows",
    "heuristic_eval",
    "fixed_member_ensemble",
    "prediction_interval",
    "stream_scores",
    "ensemble_scores",
    "ensemble_metrics",
)

# Tables cached after a query, for those that follow; filling the cache is timed as well.
CACHED = {"customer_base": "customers", "training_base": "labelled"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    # Warm the JVM and the file system cache with a query that is not measured.
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    timings: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
        if name in CACHED:
            start = time.time()
            getattr(workspace(spark, folder), CACHED[name]).count()
            timings[f"{name}_cached"] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from feira.plans.queries import QUERIES

HEADLINE = (
    "price_changes price_alerts global_metrics coverage_by_chain completeness_by_chain history_depth largest_spread price_quartiles "
    "search_and best_store price_matrix basket_routes near_me nearest_stores_of_customers daily_panel rolling_features anomalies "
    "snapshot_upsert history_append batch_dedup forecast_metrics win_rate backtest_summary sliding_window_monitor"
).split()

#: Timed beside, and not part of the total, which is of the same queries in every round.
OTHERS = "page_records page_outline panel_refresh linear_model recursive_forecast monte_carlo_forecast permutation_importance model_comparison".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["coverage_by_chain"](spark, sf_dir).collect()  # starts the session

    def seconds(name: str) -> float:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    took, others = ({name: seconds(name) for name in names} for names in (HEADLINE, OTHERS))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "others": others, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

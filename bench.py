"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "level_frequencies",
    "customer_frequencies",
    "weight_of_evidence",
    "weight_of_evidence_by_variable",
    "information_value",
    "target_by_month",
    "stability_index",
    "independence_test_suppliers",
    "cramers_v_matrix",
    "categorical_profile_tests",
    "numeric_summary",
    "class_tests",
    "score_metrics",
    "quantile_bins",
    "threshold_bins",
    "numeric_stability_index",
    "digitised_table",
    "imputed_values",
    "density_curve",
    "risk_order",
    "one_hot_training",
    "logit_metrics",
    "stepwise_first_step",
    "scorecard_points",
    "fold_balance",
]


def main() -> None:
    from pyspark.sql import SparkSession

    import workload
    from riskloom.sources.shared import drop_shared

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("riskloom-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the executor threads and the Parquet reader before the clock
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        workload.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    drop_shared(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

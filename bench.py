"""Times the headline queries and prints one JSON line.

Derived tables are rebuilt for every query, so each time is the cost of the whole query from the raw tables; one small
query runs first to start the JVM and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from emberwatch.plans.durable import name_local_folder  # noqa: E402
from emberwatch.queries.base import REGISTRY, finish, tables  # noqa: E402
from emberwatch.queries import catalog  # noqa: E402, F401

HEADLINE = [
    "u0_telemetry_grid",
    "w1_rolling_mean",
    "w1_rolling_mean_events",
    "j3_next_incident_events",
    "i20_dataset_build",
    "i18_quality_suite",
    "a3_describe_lineitem",
    "a14_event_quartiles",
    "a19_ranking_metrics_events",
    "w10_reference_percentile",
    "d1_zscore",
    "d2_tukey_iqr",
    "d8_suite_scores",
    "d16_risk_fusion",
    "flagship_latest_risk",
    "a22_a23_lineitem_drift",
    "i1_evidence",
    "i4_document_keywords",
    "i7_answer_validation",
    "i17_incident_run",
    "i2_correlated_logs",
    "g3_stream_features",
    "g7_stream_log_correlation",
    "d10_logistic_regression",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    name_local_folder(spark).sparkContext.setLogLevel("ERROR")
    finish(REGISTRY["u1_union_tables"].build(tables(spark, folder))).collect()

    wanted = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in wanted:
        began = time.perf_counter()
        df = finish(REGISTRY[name].build(tables(spark, folder, fresh=True)))
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

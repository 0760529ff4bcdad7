"""Times the headline queries at ``$BENCH_SF_DIR`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from tablepulse import catalog
from tablepulse.session import build_session

HEADLINE = [
    "dq_score_by_event_type",
    "dq_16_profile",
    "dq_03_duplicate_documents",
    "dr_13_drift_run",
    "dr_04_psi",
    "dr_07_category_shift",
    "co_09_cost_report",
    "he_10_summary",
    "he_01_types_of_texts",
    "med_01_silver_additions",
    "med_04_gold_measures",
    "sch_03_promote_texts",
    "sch_04_sample_values",
    "reg_02_latest_values",
    "mq_08_overall_health",
    "mq_09_run_kpis",
    "mq_12_task_timeline",
    "mq_13_lineage_summary",
    "mq_26_cost_kpis",
    "st_04_dataset_totals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cores}]",
        **{"spark.sql.shuffle.partitions": cores, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.callables()
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )


if __name__ == "__main__":
    main()

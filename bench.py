"""Times the headline queries and prints one JSON line.

Every query runs four times into a sink that discards the rows; the median of the last
three counts. Nothing is cached between runs: each one reads the tables and joins again.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402
from vendastat.session import get_session  # noqa: E402

HEADLINE = [
    "order_fact",
    "customer_metrics",
    "rfm_segments",
    "rfm_segments_distributed",
    "cohort_retention",
    "monthly_kpis",
    "product_performance",
    "seller_performance",
    "state_performance",
    "new_vs_returning",
    "payment_analysis",
    "data_quality",
    "executive_kpis",
    "rfm_segment_summary",
    "seller_kpis",
    "cohort_matrix",
    "brief_validation",
]


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "vendastat-bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    first, median = {}, {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        times = [run(QUERIES[name], spark, folder) for _ in range(4)]
        first[name] = round(times[0], 3)
        median[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(median.values()), 3),
                "unit": "sec",
                "queries": median,
                "first_run": first,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()

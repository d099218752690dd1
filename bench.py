"""Time the headline queries on one data folder and print one JSON line.

BENCH_SF_DIR names the folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores. Each
query runs twice, so that compiling the JVM's own code does not count; the faster run is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalogue.spark_queries import QUERIES  # noqa: E402
from featurespark.session import get_session  # noqa: E402

HEADLINE = (
    "profile_numeric",
    "profile_categorical",
    "duplicate_columns",
    "analyze_events",
    "pearson",
    "spearman",
    "fill_median",
    "standard_scale",
    "one_hot",
    "binning",
    "date_features",
    "value_ratio_texts",
    "sensitive_columns",
    "plan_run",
    "token_estimates",
    "budget_turns",
    "budget_documents",
)

RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").groupBy("r_name").count().collect()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

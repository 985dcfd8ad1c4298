"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all) choose the run.
Every query first runs once to warm the JVM (reported as "first_run"), then BENCH_RUNS times
(default 2) to its last row; the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import all_queries  # noqa: E402
from stepwell import get_spark  # noqa: E402

HEADLINE = [
    "funnel_entry_72h",
    "funnel_previous_72h",
    "funnel_heavy_users",
    "funnel_filtered",
    "funnel_by_channel",
    "funnel_by_user_channel",
    "funnel_cube",
    "naive_funnel",
    "funnel_compare_72h",
    "overcount_reasons",
    "orders_funnel_ties",
    "ship_funnel",
    "step_times",
    "window_sweep",
    "retention_week",
    "retention_month",
    "retention_matrix",
    "blended_curve",
    "retention_by_channel",
    "mix_shift",
    "kpi_row",
    "retention_consecutive_month",
    "cohort_cube",
    "fulfilment_retention",
    "event_quality",
    "never_did",
    "first_events",
    "event_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    partitions = cpus if cpus != "*" else str(os.cpu_count())
    spark = get_spark(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=partitions
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold = {name: run(name) for name in HEADLINE}
    seconds = {name: min(run(name) for _ in range(runs)) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": cold,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

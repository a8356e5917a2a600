"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local
threads, ``BENCH_QUERIES`` a comma-separated choice (default: the list below;
``all`` runs every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidewatch.queries import QUERIES
from tidewatch.session import build_session

HEADLINE = [
    "a04_parquet_scan",
    "a08_parquet_write",
    "a12_partition_split",
    "a26_topic_to_table",
    "b08_log_terms",
    "b18_guarded_ratio",
    "c03_anti_join",
    "c06_two_key_collect",
    "c07_tag_expression",
    "c09_row_comparison",
    "c12_round_trip_match",
    "d06_metric_sum",
    "d11_percentiles",
    "d12_sum_across_series",
    "d15_all_members",
    "d16_duplicate_groups",
    "d18_children_per_parent",
    "e01_alarm_per_series",
    "e02_state_transitions",
    "e03_anomaly_band",
    "e05_latest_per_key",
    "e08_row_position",
    "g04_multiset_difference",
    "i02_tumbling_windows",
    "i03_fill_periods",
    "j01_validate",
    "j03_format_round_trip",
    "k06_effective_permissions",
    "l06_unique",
    "l13_active_children",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One scan starts the JVM's code paths; its time is not counted.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().write.format("noop").mode(
        "overwrite"
    ).save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # The sink takes every row of the result without bringing it to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()

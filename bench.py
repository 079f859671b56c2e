"""Times the headline queries and prints one JSON line.

Each query is written to the ``noop`` sink: one warm-up run, then the median of three.
BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated names, or ``all``) select what is run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from sluice.plans import QUERIES
from sluice.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3

HEADLINE = (
    "routed_topic_totals",
    "route_lookup",
    "subscribed_topics",
    "record_totals",
    "recent_records",
    "topic_batches",
    "batch_outcome_totals",
    "count_batches",
    "count_or_time_batches",
    "envelope_scan",
    "rekeyed",
    "rule_filter",
    "field_select",
    "int_or_default",
    "nested_flat_map",
    "deep_merge",
    "any_to_json",
    "published_records",
    "message_requests",
    "seed_steps",
    "example_samples",
    "json_path_types",
    "latest_schemas",
    "schema_diffs",
    "current_documents",
    "change_outcomes",
    "dispatched_stream",
)


def seconds(query, spark) -> float:
    started = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        seconds(QUERIES[name], spark)
        times[name] = round(statistics.median(seconds(QUERIES[name], spark) for _ in range(RUNS)), 4)
        print(f"{name} {times[name]}", file=sys.stderr)
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "spark": spark.version,
        "master": spark.sparkContext.master,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "date": time.strftime("%Y-%m-%d"),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()

"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). With
``--all`` every query is timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harvestry.catalog import load_all  # noqa: E402
from harvestry.session import SPREAD, build_session  # noqa: E402

HEADLINE = [
    "governance_summary",
    "governed_items",
    "simhash_fingerprint",
    "near_duplicate_pairs",
    "near_duplicate_survivors",
    "exact_dedup",
    "incremental_dedup_detail",
    "archived_skip_by_engine",
    "collect_run_summary",
    "node_table",
    "css_elements",
    "record_assembly",
    "rule_run_over_pages",
    "selector_health",
    "api_record_assembly",
    "archive_single_pages",
    "storage_table_ids",
    "positioned_table",
    "grid_table",
    "match_task_runs",
    "match_older_item",
    "task_event_fold",
    "trust_blend",
    "subject_platform_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus, SPREAD: cpus})
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_all()
    names = list(entries) if "--all" in sys.argv else HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times: dict[str, float] = {}
    for name in names:
        started = time.time()
        entries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time

from fabtrail.catalog import QUERIES
from fabtrail.session import build_session

HEADLINE = [
    "filter_all_predicates",
    "latest_logs",
    "summary_stats",
    "hourly_volume",
    "top_anomalies_by_file",
    "ingest_report",
    "shift_report",
    "shipment_volume",
    "preceding_events",
    "preceding_events_one_busy_tool",
    "cumulative_series",
    "latest_entry_per_tool",
    "text_round_trip",
    "syslog_round_trip",
    "kv_round_trip",
    "json_round_trip",
    "csv_files",
    "xml_files",
    "parquet_scan",
    "framed_binary",
    "hex_rows",
    "sniff_documents",
    "guard_documents",
    "mined_templates",
    "append_new_ids",
    "approve_review",
    "broker_messages",
    "ingest_mixed_files",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "fabtrail-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = [n for n in HEADLINE if not wanted or n in wanted.split(",")]
    seconds = {}
    for name in names:
        started = time.perf_counter()
        # every column of every row is computed, nothing is sent to the driver
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "events": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

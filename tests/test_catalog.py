"""Registered queries against their SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest
from conftest import ROOT, SF

sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from check_queries import TABLES, canonical  # noqa: E402

# the others run with: python check_queries.py
NAMES = [
    "filter_all_predicates", "search_wildcard", "summary_stats", "value_lists", "hourly_volume", "first_warnings",
    "preceding_events", "preceding_events_one_busy_tool", "cumulative_series", "latest_entry_per_tool",
    "text_round_trip", "syslog_round_trip", "kv_words", "json_array", "csv_files", "xml_files", "parquet_scan",
    "framed_binary", "nul_separated_pairs", "hex_dump", "raw_lines", "sniff_documents", "guard_documents",
    "timestamps_to_iso", "numbers_to_text", "alias_resolution", "nested_json", "template_remap",
    "records_with_header_mapping", "append_new_ids", "approve_review", "mined_templates", "broker_messages",
]


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = sql.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(os.path.join(ROOT, "bench.py"))

"""Searches that skip files by what these may hold."""

import pytest

from fabtrail.operators import tables
from fabtrail.operators.filters import filter_logs
from fabtrail.operators.tables import LogStore

ROWS = [
    # id, file, timestamp, tool, message, event
    ("1", "a b.log", "2024-01-01T00:00:00", "T1", "Pump 7 failed", "Fault"),
    ("2", "c%20d.log", "2024-01-02T00:00:00", "T2", "valve opened", None),
    ("3", "e.log", "2024-01-03T00:00:00", "T1", "ΟΔΟΣ Σίγμα straße 😀😀😀", "x"),
    ("4", "f.log", None, "T3", None, None),
    ("5", "g.log", "2024-01-05T00:00:00", "T3", "100% of a_b", ""),
    ("6", "h.log", "2024-01-05T00:00:00", None, "w " * 5000 + "needle", "ab"),
]
COLUMNS = "id string, source_filename string, timestamp string, tool_id string, raw_message string, event_name string"


def made(spark, folder):
    store = LogStore(spark, f"file://{folder}/store")
    store.create()
    store.append_logs(spark.createDataFrame(ROWS, COLUMNS))
    store.index_files()
    return store


@pytest.fixture
def store(spark, tmp_path):
    return made(spark, tmp_path)


@pytest.fixture(scope="module")
def same_store(spark, tmp_path_factory):
    return made(spark, tmp_path_factory.mktemp("slices"))


def read_files(frame):
    """How many files the scan of a plan has opened."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    metrics = plan.collectLeaves().head().metrics()
    # where no file may have a hit there is no scan
    return metrics.apply("numFiles").value() if metrics.contains("numFiles") else 0


@pytest.mark.parametrize(
    "conditions, files",
    [
        ({"search_term": "PUMP"}, 1),
        ({"search_term": "pump%fail_d"}, 1),
        ({"search_term": "οδος"}, None),
        ({"search_term": "σίγμα"}, None),
        ({"search_term": "😀😀😀"}, 1),
        ({"search_term": "needle"}, 1),
        ({"search_term": "%"}, 6),
        ({"search_term": "ab"}, 6),
        ({"search_term": r"100\%"}, 1),
        ({"search_term": r"a\_b"}, 6),
        ({"search_term": "no such text"}, 0),
        ({"tool_id": "T1"}, 2),
        ({"start_ts": "2024-01-02T00:00:00", "end_ts": "2024-01-03"}, 1),
        ({"start_ts": "2024-01-05"}, 2),
        ({"search_term": "valve", "tool_id": "T1"}, 0),
        ({"severity": "ERROR"}, None),
        ({}, None),
    ],
)
def test_search_skips_files_and_loses_nothing(same_store, conditions, files):
    store = same_store
    found = store.find(**conditions)
    want = filter_logs(store.read("logs"), **conditions)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in want.collect())
    if files is not None:
        assert read_files(store.find(**conditions)) == files


def test_files_without_an_entry_are_read(spark, store, monkeypatch):
    new = [("7", "a b.log", "2024-02-01T00:00:00", "T9", "pump 8 failed", None), ("8", "n.log", "2024-02-01T00:00:00", "T9", "door", None)]
    store.append_logs(spark.createDataFrame(new, COLUMNS))
    ids = lambda frame: sorted(r.id for r in frame.collect())
    assert ids(store.find(search_term="pump")) == ["1", "7"] and ids(store.find(tool_id="T9")) == ["7", "8"]
    assert read_files(store.find(search_term="pump")) == 3
    store.index_files()
    store.index_files()
    assert len(store._versions("slices")) == 2 and read_files(store.find(search_term="pump")) == 2
    # entries of files that are gone are not looked at
    store.replace_file("a b.log", spark.createDataFrame([("9", "a b.log", "2024-02-02T00:00:00", "T9", "pump 9", None)], COLUMNS))
    assert ids(store.find(search_term="pump")) == ["9"]
    monkeypatch.setattr(tables, "MOST_FOUND_FILES", 0)
    assert ids(store.find(search_term="pump")) == ["9"]
    results = spark.createDataFrame([("9", "s", "c", "h")], "id string, summary string, classification string, root_cause_hint string")
    store.enrich(results)
    assert [r.ai_summary for r in store.find(search_term="pump").collect()] == ["s"]


def test_empty_table(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/store")
    assert store.find(search_term="x").collect() == []
    store.create()
    store.index_files()
    assert store.find(search_term="x").collect() == []

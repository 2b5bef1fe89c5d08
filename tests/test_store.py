"""Versions of tables, results laid over the logs, appends that read the folders of their files only, and the live view of a stream."""

import shutil

import pytest
from conftest import SF, TS
from pyspark.sql import functions as F

from fabtrail import schema as S
from fabtrail.catalog.base import logs_from_events
from fabtrail.operators import tables
from fabtrail.operators.filters import live_view
from fabtrail.operators.tables import LogStore
from fabtrail.streaming import ingest as M


@pytest.fixture
def store(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/store")
    store.create()
    return store


def template(spark, name, signature="s"):
    row = spark.createDataFrame([(name, name, signature, "2024")], "id string, name string, file_signature string, created_at string")
    return row


def names(store):
    return sorted(r.id for r in store.read("format_templates").collect())


def log_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, source_filename string, severity string")


def test_a_rewrite_that_breaks_off_leaves_the_table(spark, store, tmp_path):
    store.save_template(template(spark, "t1"))
    folder = tmp_path / "store" / "format_templates"
    (current,) = folder.iterdir()
    # step 1: the next version was begun
    unfinished = folder / "v00000009"
    shutil.copytree(current, unfinished)
    (unfinished / "_SUCCESS").unlink()
    assert names(store) == ["t1"]
    store.create()
    assert names(store) == ["t1"]
    # step 2: it was finished, the old one is still there
    store.save_template(template(spark, "t2", "other"))
    shutil.copytree(folder / "v00000010", folder / "v00000003")
    assert names(store) == ["t1", "t2"]
    store.create()
    store.delete_template("t1")
    assert names(store) == ["t2"] and [p.name for p in folder.iterdir()] == ["v00000011"]


def test_cleared_tables_take_rows_again(spark, store):
    rows = log_rows(spark, [("1", "a", "INFO"), ("2", "b", "ERROR")])
    assert store.append_logs(rows).inserted == 2
    store.clear()
    assert store.read("logs").count() == 0
    assert store.append_logs(rows).inserted == 2 and store.append_logs(rows).inserted == 0


def results(spark, *rows):
    return spark.createDataFrame([(i, s, "c", None) for i, s in rows], "id string, summary string, classification string, root_cause_hint string")


def summaries(store):
    return {r.id: r.ai_summary for r in store.read("logs").collect()}


def parts(tmp_path):
    return sorted(str(p) for p in (tmp_path / "store" / "logs").rglob("part-*"))


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_results_are_laid_over_the_logs(spark, store, tmp_path, monkeypatch, most):
    monkeypatch.setattr(tables, "MOST_LAID_OVER", most)
    store.append_logs(log_rows(spark, [(str(k), f"f{k % 2}", "INFO") for k in range(6)]))
    before = parts(tmp_path)
    store.enrich(results(spark, ("1", "first"), ("2", "two")))
    assert parts(tmp_path) == before
    store.enrich(results(spark, ("1", "second"), ("absent", "x")))
    want = {"0": None, "1": "second", "2": "two", "3": None, "4": None, "5": None}
    assert summaries(store) == want
    # beyond the limit they are settled
    assert bool(store._laid_over()) == (most > 2)
    store.settle_enrichment()
    store.settle_enrichment()
    assert summaries(store) == want and not store._laid_over()


def test_settling_that_breaks_off_does_no_harm(spark, store, monkeypatch):
    store.append_logs(log_rows(spark, [("1", "a", "INFO"), ("2", "b", "INFO")]))
    store.enrich(results(spark, ("1", "one")))
    with monkeypatch.context() as patch:
        patch.setattr(LogStore, "_drop_before", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.settle_enrichment()
    assert summaries(store) == {"1": "one", "2": None}
    store.settle_enrichment()
    assert summaries(store) == {"1": "one", "2": None}


def test_results_go_with_their_file(spark, store):
    rows = log_rows(spark, [("1", "a", "INFO"), ("2", "b", "INFO")])
    store.append_logs(rows)
    store.enrich(results(spark, ("1", "one"), ("2", "two")))
    store.replace_file("a", rows)
    assert summaries(store) == {"1": None, "2": "two"}
    store.delete_file("b")
    store.append_logs(rows)
    assert summaries(store) == {"1": None, "2": None}


@pytest.mark.parametrize("named", [10_000, 1])
def test_appends_read_the_folders_of_their_files(spark, store, monkeypatch, named):
    monkeypatch.setattr(tables, "MOST_NAMED_FILES", named)
    store.append_logs(log_rows(spark, [(str(k), f"f{k}", "INFO") for k in range(20)]))
    new = log_rows(spark, [("3", "f3", "INFO"), ("x", "f3", "INFO"), ("4", "f4", "INFO"), ("n", "g", "INFO")])
    if named > 1:
        plan = store._of_files(store._stored("logs"), new, "source_filename")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [source_filename" in plan.replace("(", "").replace("isnotnull", "")
        assert store._of_files(store._stored("logs"), new, "source_filename").inputFiles() is not None
    assert store.append_logs(new, within_files=True).inserted == 2
    assert store.read("logs").count() == 22


def test_live_view_of_a_stream_equals_that_of_the_table(spark, tmp_path):
    logs = logs_from_events(spark, SF).withColumn("source_filename", F.concat(F.lit("mqtt_"), "tool_id", F.lit(".json")))
    logs = logs.limit(900).cache()
    view = M.LiveView(spark, f"file://{tmp_path}/view", limit=40)
    for part in range(3):
        # files of one batch each
        logs.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(S.LOGS).parquet(str(tmp_path / "in"))
        view.start(source, str(tmp_path / "cp"), available_now=True).awaitTermination()
        want = live_view(logs.where(F.pmod(F.xxhash64("id"), F.lit(3)) <= part), 40).collect()
        assert view.read().collect() == want
    # the last batch once more
    view.write(logs.where(F.pmod(F.xxhash64("id"), F.lit(3)) == 2), 2)
    assert view.read().collect() == want
    assert len(list((tmp_path / "view").iterdir())) <= 2 and view._rows().count() == 40
    logs.unpersist()


def test_messages_once(spark, tmp_path):
    rows = [("t", "a", "2024-01-01 00:00:00"), ("t", "a", "2024-01-01 00:10:00"), ("t", "b", "2024-01-01 00:20:00"), ("u", "a", "2024-01-01 00:30:00")]
    schema = "topic string, payload string, timestamp string"
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("timestamp", F.to_timestamp("timestamp"))

    def run():
        sink = M.distinct_messages(read()).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        sink.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.topic, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert run() == [("t", "a"), ("t", "b"), ("u", "a")]
    # a repeat in a later batch, within the hour
    spark.createDataFrame([("t", "b", "2024-01-01 00:40:00"), ("t", "c", "2024-01-01 00:40:00")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [("t", "a"), ("t", "b"), ("t", "c"), ("u", "a")]
    assert TS


def test_clusters_stay(spark, store):
    first = ["pump failed one now", "pump failed two now", "valve opened a fully today"]
    second = ["pump failed three now", "valve opened b fully today", "door locked", "pump failed one now"]
    rows = lambda lines: spark.createDataFrame([(str(k), t) for k, t in enumerate(lines)], "id string, raw_message string")
    given = lambda frame: {r.raw_message: (r.drain_cluster_id, r.drain_template) for r in frame.collect()}
    one = given(store.with_templates(rows(first)))
    two = given(store.with_templates(rows(second)))
    again = given(store.with_templates(rows(first + second)))
    # what was given once is given again, and new messages join the clusters there are
    assert again == one | two and two[first[0]] == one[first[0]]
    assert one[first[0]][0] == one[first[1]][0] == two[second[0]][0]
    assert len({c for c, _ in again.values()}) == len({t for _, t in again.values()})
    assert two["door locked"][0] not in {c for c, _ in one.values()}
    assert given(store.with_templates(rows([""]))) == {"": (None, None)}


def test_streamed_rows_get_clusters(spark, store, tmp_path):
    messages = [("fab/tool_logs/T1", f'{{"message": "pump {k} failed", "timestamp": "2024-01-01T00:00:0{k}"}}') for k in range(4)]

    def run():
        source = spark.readStream.schema("topic string, payload binary").parquet(str(tmp_path / "in"))
        M.stream_ingest(source, store, str(tmp_path / "cp"), ingest_ts=TS, available_now=True, mine=True, pack_every=1).awaitTermination()
        return {r.raw_message: r.drain_cluster_id for r in store.read("logs").collect()}

    for part in (messages[:2], messages[2:]):
        spark.createDataFrame(part, "topic string, payload string").select("topic", F.col("payload").cast("binary").alias("payload")).coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))
        found = run()
    assert len(found) == 4 and len(set(found.values())) == 1 and None not in found.values()
    # the files of both batches were packed into one
    assert len([p for p in parts(tmp_path) if "source_filename=" in p]) == 1


def stored_rows(store):
    return sorted((r.id, r.source_filename, r.severity) for r in store.read("logs").collect())


def with_small_files(spark, store, batches=4):
    names = ["a.log", "b c+d:e%2F=f.log"]
    for k in range(batches):
        store.append_logs(log_rows(spark, [(f"{k}-{n}", name, "INFO") for n, name in enumerate(names)]), within_files=True)
    store.append_logs(log_rows(spark, [("alone", "one.log", "ERROR")]))


def test_small_files_are_packed(spark, store, tmp_path):
    assert store.pack_files("logs") == 0
    with_small_files(spark, store)
    before, files = stored_rows(store), parts(tmp_path)
    assert store.pack_files("logs") == 8
    assert stored_rows(store) == before and len(parts(tmp_path)) == len(files) - 6
    # nothing is left to pack, and appends, files' folders and packing go on
    assert store.pack_files("logs") == 0
    with_small_files(spark, store, 5)
    assert len(stored_rows(store)) == 11 and store.pack_files("logs") == 4 and len(stored_rows(store)) == 11
    store.delete_file("b c+d:e%2F=f.log")
    assert {f for _, f, _ in stored_rows(store)} == {"a.log", "one.log"}
    # files of half the size are left alone
    assert store.small_files("logs", packed_bytes=2).count() == 0


def test_bins_have_a_size(spark, store):
    with_small_files(spark, store, 5)
    size = store.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store.path("logs")).agg(F.max("length")).first()[0]
    bins = store.small_files("logs", packed_bytes=2 * size + 2).groupBy("bin").count().collect()
    assert len(bins) >= 2 and all(2 <= r["count"] <= 3 for r in bins)


@pytest.mark.parametrize("step", ["list", "move", "delete", "forget"])
def test_packing_that_breaks_off_is_finished(spark, store, tmp_path, step):
    with_small_files(spark, store)
    before, files = stored_rows(store), parts(tmp_path)
    put, done = LogStore._put_in_place, []

    class Lost(Exception):
        pass

    class Fails:
        """A file system that is lost at the second call of a kind."""

        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return getattr(self.system, name)

        def _call(self, name, kind, *args):
            done.append(kind)
            if kind == step and done.count(kind) == 2:
                raise Lost
            return getattr(self.system, name)(*args)

        def rename(self, *args):
            return self._call("rename", "move", *args)

        def delete(self, path, recursive):
            return self._call("delete", "forget" if recursive else "delete", path, recursive)

    with pytest.MonkeyPatch.context() as patch:
        if step == "list":
            # the packed files are written, their list is not
            patch.setattr(LogStore, "_put_in_place", lambda self, table: None)
            store.pack_files("logs")
            (list_of,) = (tmp_path / "store" / "logs_replaced").iterdir()
            (list_of / "_SUCCESS").unlink()
        else:
            system_of = LogStore._file_system
            patch.setattr(LogStore, "_file_system", lambda self, path: (system_of(self, path)[0], Fails(system_of(self, path)[1])))
            with pytest.raises(Lost):
                store.pack_files("logs")
    assert put is LogStore._put_in_place and stored_rows(store) == before
    store.pack_files("logs")
    assert stored_rows(store) == before and len(parts(tmp_path)) == len(files) - 6


def test_guard_of_stored_messages_runs_once(spark):
    from fabtrail.streaming import ingest as M

    rows = [
        ("fab/tool_logs/T-1", b'[{"tool_id": "T-1", "severity": "INFO", "message": "pressure"}, 1]'),
        ("fab/tool_logs/T-2", b'{"tool_id": "T-2", "timestamp": "2024-06-01T00:00:00", "message": "wafer"}'),
        ("short", b"hello there"),
        ("fab/tool_logs/T-3", b'[1, 2] tool_id wafer pressure'),
        ("fab/tool_logs/T-4", None),
    ]
    messages = spark.createDataFrame(rows, "topic string, payload binary")
    opened = M.opened(messages)
    assert "payload" not in opened.columns
    show = lambda frame: sorted(map(str, frame.drop("id", "row").collect()))
    assert show(M.message_warnings(opened)) == show(M.message_warnings(messages))
    at = "2024-06-01T00:00:00"
    assert show(M.message_logs(opened, at)) == show(M.message_logs(messages, at))
    # what is stored needs neither the guard nor the search for objects again
    again = spark.createDataFrame(opened.collect(), opened.schema)
    for frame in (M.message_warnings(again), M.message_records(again)):
        assert "0x[0-9a-fA-F]+" not in frame._jdf.queryExecution().optimizedPlan().toString()

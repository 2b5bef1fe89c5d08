"""Ordering, sequences, templates, tables and streams on small inputs, some of them skewed."""

import json
import random

import pytest
from conftest import SF, TS
from pyspark.sql import functions as F

from fabtrail import schema as S
from fabtrail.catalog.base import logs_from_events
from fabtrail.operators import ordering as O, sequences as W, templates as T
from fabtrail.operators.tables import LogStore
from fabtrail.plans.ingest import ingest
from fabtrail.sources.render import render, write_framed
from fabtrail.streaming import ingest as M


def test_rows_are_numbered_through(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").repartition(7)
    got = [(r["k"], r["id"], r["_pos"]) for r in O.number_rows(df, ["k", "id"]).collect()]
    want = sorted((i % 3, i) for i in range(1000))
    assert sorted(got) == sorted((k, i, n) for n, (k, i) in enumerate(want))


def test_occurrences_of_one_hot_row(spark):
    df = spark.range(900).select(F.when(F.col("id") < 600, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("line"))
    got = O.occurrence_number(df, ["line"], "n").collect()
    assert sorted(r["n"] for r in got if r["line"] == "hot") == list(range(600))
    assert all(r["n"] == 0 for r in got if r["line"] != "hot")


def test_lookup_keeps_every_row(spark):
    left = spark.range(500).select("id", F.when(F.col("id") < 300, F.lit("hot")).when(F.col("id") < 310, F.lit(None)).otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    right = spark.createDataFrame([("hot", 1), ("k400", 2), ("unused", 3)], "key string, v int")
    got = {r["id"]: r["v"] for r in O.lookup_join(left, right, ["key"]).collect()}
    assert len(got) == 500 and got[0] == 1 and got[400] == 2 and got[305] is None and got[450] is None


@pytest.mark.parametrize("tools", [1, 3])
def test_preceding_events_by_brute_force(spark, tools):
    pick = random.Random(5)
    rows = [
        (f"{i:04d}", f"t{pick.randint(0, 40):03d}", f"T{i % tools}", pick.choice(["INFO", "ERROR"]), "f" if i % 5 else "g")
        for i in range(400)
    ]
    cols = {"id": 0, "timestamp": 1, "tool_id": 2, "severity": 3, "source_filename": 4}
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    df = df.select(*[(F.col(f.name) if f.name in cols else F.lit("x" if f.name == "raw_message" else None)).cast(f.dataType).alias(f.name) for f in S.LOGS])
    got = {(r["fault_id"], r["steps_back"], r["id"]) for r in W.preceding_events(df, 7).collect()}
    want = set()
    for f in rows:
        if f[3] == "ERROR":
            before = sorted((r for r in rows if r[2] == f[2] and r[4] == f[4] and r[1] <= f[1]), key=lambda r: (r[1], r[0]))
            want |= {(f[0], n + 1, r[0]) for n, r in enumerate(reversed(before[-7:]))}
    assert got == want


def test_lookup_of_a_hot_key_that_is_absent(spark):
    left = spark.range(400).select("id", F.when(F.col("id") < 390, F.lit("hot")).otherwise(F.lit("cold")).alias("key"))
    right = spark.createDataFrame([("cold", 1)], "key string, v int")
    got = O.lookup_join(left, right, ["key"])
    assert got.count() == 400 and got.where("v = 1").count() == 10
    # all rows of the hot key must not be in one task after the join
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = got.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 250
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_templates_do_not_depend_on_order_or_partitions(spark):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    lines = [f"Pump fault at {a} by {b} today ok" for a in words for b in words] + ["Door open now"] * 5
    rows = list(enumerate(lines))
    df = spark.createDataFrame(rows, "id int, raw_message string")
    whole = T.mine_templates(df)
    turned = T.mine_templates(df.orderBy(F.desc("id")))
    chunked = T.mine_templates(df.repartition(7))
    expected = {"Pump fault at <*> by <*> today ok", "Door open now"}
    for found in (whole, turned, chunked):
        assert {r[0] for r in found.select("drain_template").distinct().collect()} == expected
        assert found.count() == len(rows) and found.where("drain_cluster_id is null").count() == 0


def test_dissimilar_messages_stay_apart(spark):
    lines = ["a b c d e f", "a b x y z w", "a b c d e q"]
    df = spark.createDataFrame([(x,) for x in lines], "raw_message string")
    got = {r[0]: r[1] for r in T.mine_templates(df).select("raw_message", "drain_template").collect()}
    assert got[lines[0]] == got[lines[2]] == "a b c d e <*>" and got[lines[1]] == "a b x y z w"


def test_store_round_trip(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.create()
    logs = logs_from_events(spark, SF)
    n = logs.count()
    assert (store.append_logs(logs).inserted, store.append_logs(logs).inserted) == (n, 0)
    name = logs.first()["source_filename"]
    store.delete_file(name)
    kept = store.read("logs").count()
    assert kept == logs.where(F.col("source_filename") != name).count()
    store.replace_file(name, logs)
    assert store.read("logs").count() == n
    assert {r[0] for r in store.read("logs").select("source_filename").distinct().collect()} == {
        r[0] for r in logs.select("source_filename").distinct().collect()
    }


def test_framed_files_round_trip(spark, tmp_path):
    logs = logs_from_events(spark, SF).repartition(3)
    path = str(tmp_path / "framed")
    assert write_framed(logs, path) == logs.count()
    found = ingest(spark, path, ingest_ts=TS, mine=False).logs
    columns = ["timestamp", "tool_id", "severity", "event_name", "wafer_id"]
    assert found.select(*columns).exceptAll(logs.select(*columns)).count() == 0
    assert found.count() == logs.count()


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    logs = logs_from_events(spark, SF).limit(200)
    messages = render(logs, "json").select(
        F.concat(F.lit("fab/tool_logs/"), "tool_id").alias("topic"), F.col("line").cast("binary").alias("payload")
    )
    junk = spark.createDataFrame([("fab/tool_logs/X", bytearray(b"hello"))], "topic string, payload binary")
    messages.unionByName(messages.limit(3)).unionByName(junk).write.parquet(str(tmp_path / "in" / "a"))
    store = LogStore(spark, str(tmp_path / "store"))
    store.create()

    def run():
        source = spark.readStream.schema("topic string, payload binary").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        M.stream_ingest(source, store, str(tmp_path / "cp"), ingest_ts=TS, available_now=True).awaitTermination()

    run()
    # equal messages are separate rows
    assert store.read("logs").count() == 203
    run()
    assert store.read("logs").count() == 203
    batch = M.message_logs(messages, TS).select("tool_id", "timestamp", "event_name", "source_filename")
    streamed = store.read("logs").select("tool_id", "timestamp", "event_name", "source_filename")
    assert batch.exceptAll(streamed).count() == 0
    notes = spark.read.parquet(f"{store.root}/stream_warnings")
    assert [r["source_filename"] for r in notes.collect()] == ["mqtt_X.json"]


def test_hourly_stream(spark, tmp_path):
    logs_from_events(spark, SF).write.parquet(str(tmp_path / "logs"))
    source = spark.readStream.schema(S.LOGS).parquet(str(tmp_path / "logs"))
    hours = M.hourly_volume_stream(source)
    query = hours.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hours").agg(F.sum("count")).first()[0] == logs_from_events(spark, SF).count()

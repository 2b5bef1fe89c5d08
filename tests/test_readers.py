"""Readers that split files or stream through them give the same rows however the files are cut."""

import json

import pytest
from pyspark.sql import functions as F

from fabtrail import session
from fabtrail.functions import entries as E
from fabtrail.operators import lookups
from fabtrail.operators.tables import LogStore
from fabtrail.sources import binary as B, structured as ST
from fabtrail.sources.files import list_files

def records(frame):
    rows = frame.orderBy("block", "row").collect()
    return [{e.key: e.value for e in r.entries} for r in rows]


@pytest.mark.parametrize("split", ["1g", "40"])
def test_nul_pairs_do_not_depend_on_splits(spark, write, split):
    pieces = [b"\xff", b"timestamp=1", b" tool=A ", b"", b"timestamp=2", b"tool=B", b"no pair", b"x=1", b"timestamp=3", b"x=2", b"x=3", b"timestamp=4"]
    path = write(nul__bin=b"\x00".join(pieces * 3))
    want = [
        {"timestamp": "1", "tool": "A", "raw_message": "timestamp=1 | tool=A"},
        {"timestamp": "2", "tool": "B", "raw_message": "timestamp=2 | tool=B"},
        {"x": "3", "timestamp": "3", "raw_message": "x=3 | timestamp=3"},
        {"timestamp": "4", "raw_message": "timestamp=4"},
    ] * 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert records(B.read_universal(list_files(spark, path))) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    value = spark.createDataFrame([(bytearray(b"\x00".join(pieces * 3)),)], "content binary")
    assert records(B.decode_content(value).withColumn("block", F.lit(0))) == want


def test_cut_frames_are_reported(spark, write):
    frame = lambda k: (lambda p: len(p).to_bytes(4, "little") + p)(f"tool_id=T{k}\x00value={k}0000".encode())
    path = write(a__bin=B.MAGIC + frame(1) + frame(2) + frame(3)[:-3], b__bin=B.MAGIC + frame(4) + frame(5))
    index = B.frame_index(list_files(spark, path))
    found = {r.source_filename: r.error for r in B.frame_warnings(index).collect()}
    assert list(found) == ["a.bin"] and found["a.bin"].startswith("cut frame")
    rows = B.read_frames(index).collect()
    assert sorted(e.value for r in rows for e in r.entries if e.key == "tool_id") == ["T1", "T2", "T4", "T5"]


def frames_of(sizes, fill):
    return b"".join(len(p).to_bytes(4, "little") + p for p in (fill(k, n) for k, n in enumerate(sizes)))


def pairs(k, n):
    return (f"tool_id=T{k}\x00value=" + "7" * n).encode()


def decoys(k, n):
    # payloads that look like frames of their own, from any place on
    return b"\x05\x00\x00\x00abcde" * n + b"k=" + str(k).encode()


@pytest.mark.parametrize("split", [64, 100, 1000, 1 << 26])
def test_frames_do_not_depend_on_splits(spark, write, split, monkeypatch):
    sizes = [1, 40, 3, 300, 2, 90, 700, 5, 11] * 4
    head = frames_of([12, 15], pairs)
    files = {
        "plain__bin": B.MAGIC + frames_of(sizes, pairs),
        "decoys__bin": B.MAGIC + head + frames_of([s // 9 + 1 for s in sizes], decoys),
        "cut__bin": B.MAGIC + frames_of(sizes, pairs)[:-3],
        "tail__bin": B.MAGIC + frames_of(sizes, pairs) + b"xy",
        "bad__bin": B.MAGIC + frames_of(sizes[:20], pairs) + b"\xff\xff\xff\xff" + frames_of(sizes, pairs),
        "none__bin": b"\x00\x01" * 300,
        "empty__bin": b"",
        "one__bin": frames_of([30], pairs),
    }
    path = write(**files)
    found = {}
    for r in B.frame_index(list_files(spark, path), split).orderBy("row").collect():
        found.setdefault(r.source_filename, []).append((r.row, r.at, r.size, r.stopped))
    for name, data in files.items():
        ranges, stopped = B.frame_ranges(lambda at, n: data[at : at + n], len(data))  # noqa: B023
        want = [(k, at, size, None) for k, (at, size) in enumerate(ranges)] + ([(len(ranges), None, None, stopped)] if stopped else [])
        assert found.get(name.replace("__", "."), []) == want
    assert len(found["decoys.bin"]) == 38 and found["bad.bin"][-1][3].startswith("frame of")


def test_guesses_skip_what_is_no_chain_of_frames():
    data = b"tool=7\x00" * 9 + frames_of([9, 8, 7, 6, 5], pairs)
    read = lambda at, n: data[at : at + n]
    assert B.guessed_start(read, 5, len(data), len(data)) == 63
    assert B.guessed_start(read, 64, len(data), len(data)) == 63 + 4 + len(pairs(0, 9))
    assert B.guessed_start(lambda at, n: (b"\x00" * 99)[at : at + n], 1, 99, 99) == -1


@pytest.mark.parametrize("depth", [1, 7, 40])
def test_objects_of_any_depth_are_unfolded(spark, depth):
    doc = {"k": "v{", "n": None}
    for _ in range(depth):
        doc = {"a": doc, "b": [1]}
    found = spark.createDataFrame([(json.dumps(doc),)], "doc string").select(F.explode(E.json_entries(F.col("doc"))).alias("e"))
    keys = {r.e.key: r.e.value for r in found.collect()}
    assert keys["_".join("a" * depth + "k")] == "v{" and len(keys) == depth + 2


def test_first_and_last_of_a_key(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(30)], "id int, n int").coalesce(1)
    assert {r.id: r.n for r in lookups.first_per(rows, "id").collect()} == {0: 0, 1: 1, 2: 2}
    assert {r.id: r.n for r in lookups.last_per(rows, "id").collect()} == {0: 27, 1: 28, 2: 29}


def test_files_with_odd_names_are_deleted_alone(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/store")
    store.create()
    names = ["a b=c/d.log", "plain.log", "100%.log"]
    rows = spark.createDataFrame([(n, n) for n in names], "id string, source_filename string")
    store.append_logs(rows.withColumn("log_type", F.lit("recipe")))
    store.delete_file(names[0])
    store.delete_file("absent.log")
    for table in ("logs", "recipes"):
        assert {r.source_filename for r in store.read(table).collect()} == set(names[1:])


def test_scratch_goes_when_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    assert session.stored(spark.range(5), "some").count() == 5
    assert list((tmp_path / "shared" / "fabtrail").iterdir())
    session.drop_scratch(spark)
    assert not list((tmp_path / "shared" / "fabtrail").iterdir())


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://somewhere:7077"})

    with pytest.raises(ValueError):
        session.shared_dir(Session())
    Session.conf["spark.master"] = "local[2]"
    assert session.shared_dir(Session()) == session.shared_dir(Session())

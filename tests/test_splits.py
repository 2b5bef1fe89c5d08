"""Files split anywhere give the records that a parser of the whole file gives."""

import contextlib
import csv
import io
import json
from xml.etree import ElementTree

import pytest

from fabtrail.sources import splits, structured as ST
from fabtrail.sources.files import list_files

SIZES = ["1g", "64", "23"]


@contextlib.contextmanager
def splits_of(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def by_file(frame):
    found = {}
    for r in frame.orderBy("source_filename", "block", "row").collect():
        found.setdefault(r.source_filename, []).append(r)
    return found


EVENT = "<event><name>pump{0}</name><value>{0}</value></event>"
XML = {
    "a": "<log><name>fab 3</name>" + "".join(EVENT.format(k) for k in range(4)) + "</log>",
    "nested": "<r>" + "<row><row>in {}</row><x>1</x></row>".replace("{}", "a") * 5 + "</r>\n",
    "selfclosing": "<r>" + "".join(f"<row id='{k}'/>\n" for k in range(9)) + "<row id='x' /></r>",
    "comment": "<?xml version='1.0'?><!-- <r> > --><r><!-- <row> a > b --><row><!-- </row> --><a>1</a></row><!-- > --><row><a>2</a></row></r><!-- end > -->",
    "cdata": "<r><row><a><![CDATA[</row> > ]] <row>]]></a></row><row><a>b > c</a></row></r>",
    "quotes": "<r><row a='x > y' b=\"it's > 1\"><c d='\"'>text 'q' \"</c></row><row e='>'/><row f=\">\" g='1'>said</row></r>",
    "instruction": "<?xml version='1.0'?><r><?go a > b ?><row><a>1</a></row></r>",
    "doctype": "<!DOCTYPE r [ <!ELEMENT r ANY> <!ELEMENT a ANY> ]><r><row><a>1</a></row></r>",
    "spaces": "<z:r xmlns:z='urn:z' ><z:row z:a='1'><z:b>é\u20ac\U0001f600</z:b></z:row ></z:r>\n\n",
    "empty": "<r></r>",
    "alone": "<r/>",
    "textonly": "<r>text</r>",
}


@pytest.mark.parametrize("size", SIZES)
def test_xml_does_not_depend_on_splits(spark, tmp_path, size):
    for name, text in XML.items():
        (tmp_path / f"{name}.xml").write_text(text, encoding="utf-8")
    (tmp_path / "early.xml").write_text("<r><row><a>1</a></row><row><a>2</a>")
    (tmp_path / "wrong.xml").write_text("<r><row><a>1</b></row><row><a>2</a></row></r>")
    (tmp_path / "none.xml").write_text("no markup at all")
    with splits_of(spark, size):
        found = by_file(ST.read_xml(list_files(spark, str(tmp_path))))
    for name, text in XML.items():
        want = [dict((k, v) for k, v, _ in ST._xml_fields(node)) for node in ElementTree.fromstring(text)]
        rows = found.get(f"{name}.xml", [])
        assert [r.error for r in rows if r.error] == [], name
        assert [{e.key: e.value for e in r.entries} for r in rows] == [w for w in want if w], name
    for name, good in (("early", ["1"]), ("wrong", ["2"]), ("none", [])):
        rows = found[f"{name}.xml"]
        assert [r.entries[0].value for r in rows if r.entries] == good, name
        assert sum(r.error is not None for r in rows) == 1, name


ARRAYS = [
    "[]",
    "[1, 2.5]",
    ' [ {"a": 1} , 2, null, "x]", [{"no": 1}], {"b": {"c": "},{"}, "a": [1, 2]} ] ',
    '[{"long": "' + "y}" * 500 + '"}, 12345678901234567890, {"z": 1e5}]\n',
    '\ufeff[{"é": "ü\\\\\\""}, {"k": "\\\\"}, {"}": "[{"}]',
    "[[[{}], {}], {}, [{}]]",
    json.dumps([{"n": k, "t": "a\\b\"}{" * (k % 3)} for k in range(60)], indent=1),
    json.dumps([[{"deep": [{"x": 1}] * 9}], {"n": 1}, [{"deep": [{"x": 1}] * 9}], {"n": 2}]),
]
BROKEN = ["", "{}", '{"a": {"b": 1}}', "[1, 2", '[{"a": 1} {"b": 2}]', '[{"a": 1},]', '[{"a": 1}] x', "[nope]", '[{"a": nope}]', '[{"a": 1}', '[{"a": "1}', '[,{"a":1}]', '[[{"a":1},],{"a":1}]', '[{"a":1}]]', "[}"]


@pytest.mark.parametrize("size", SIZES)
def test_json_arrays_do_not_depend_on_splits(spark, tmp_path, size):
    for k, text in enumerate(ARRAYS):
        (tmp_path / f"good{k}").write_text(text, encoding="utf-8")
    for k, text in enumerate(BROKEN):
        (tmp_path / f"bad{k}").write_text(text, encoding="utf-8")
    paths = [str(p) for p in tmp_path.iterdir()]
    with splits_of(spark, size):
        found, faults = splits.records(spark, paths, splits.JsonArray())
        found = by_file(found)
        told = {r.source_filename for r in faults.collect()}
        read = by_file(ST.read_json_arrays(list_files(spark, str(tmp_path))))
    for k, text in enumerate(ARRAYS):
        want = [m for m in json.loads(text.lstrip("\ufeff")) if isinstance(m, dict)]
        assert [json.loads(r.content) for r in found.get(f"good{k}", [])] == want, text
        assert f"good{k}" not in told, text
        assert len(read.get(f"good{k}", [])) == len(want)
    assert {f for f in read if f.startswith("bad")} == set()
    for k, text in enumerate(BROKEN):
        # what holds no object in an array gives none anyway
        assert f"bad{k}" in told or f"bad{k}" not in found, text


@pytest.mark.parametrize("size", SIZES)
def test_quoted_line_ends_do_not_depend_on_splits(spark, tmp_path, size):
    rows = [["a", "b\nc"], ['said ""', ""], ["x\r\n,y", '"'], ["", "1"], ["é", "two\n\nlines"], ["p", "q"]] * 4
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerows([["tool", "the\nmessage"], *rows])
    (tmp_path / "q.csv").write_text("\n" + out.getvalue() + "last,row", encoding="utf-8", newline="")
    path = str(tmp_path / "q.csv")
    with splits_of(spark, size):
        found = ST.read_csv_group(spark, [path], ["tool", "the\nmessage"], ",", True).orderBy("block", "row").collect()
    strip = lambda v: v.strip()
    assert [[e.value for e in r.entries] for r in found] == [[strip(c) for c in r] for r in [*rows, ["last", "row"]]]


def test_splits_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(splits, "MOST_BROADCAST_SPLITS", 0)
    test_json_arrays_do_not_depend_on_splits(spark, tmp_path, "64")


def test_one_parser_takes_many_records(monkeypatch):
    calls = []
    whole = ElementTree.fromstring
    monkeypatch.setattr(ElementTree, "fromstring", lambda text: calls.append(text) or whole(text))
    good = [f"<row id='{k}'><a>{k}</a></row>" for k in range(50)]
    got = list(ST._xml_records("<r xmlns:z='urn:z'>", "r", good))
    assert [(k, dict((n, v) for n, v, _ in fields)) for k, fields, _ in got] == [(k, {"id": str(k), "a": str(k)}) for k in range(50)]
    assert len(calls) == 1
    # records that are not well-formed alone are told one by one, also where they would be so together
    got = list(ST._xml_records("<r>", "r", [good[0], "<a>", "</a><b/><c/>", good[1]]))
    assert [(k, error is None) for k, _, error in got] == [(0, True), (1, False), (2, False), (3, True)]


def test_pieces_carry_no_paths(spark, tmp_path):
    (tmp_path / "a b+%20.xml").write_text("<r><row><a>1</a></row></r>")
    pieces = splits._pieces(spark, [str(tmp_path)], splits.Xml())
    assert "string" not in dict(pieces.dtypes).values()
    rows = ST.read_xml(list_files(spark, str(tmp_path))).collect()
    assert [(r.source_filename, r.entries[0].value) for r in rows] == [("a b+%20.xml", "1")]

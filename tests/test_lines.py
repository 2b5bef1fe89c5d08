"""Line parsers and rules against expectations worked out by hand."""

import json

import pytest
from conftest import TS
from pyspark.sql import functions as F

from fabtrail.functions import entries as E
from fabtrail.functions import masking, sniff
from fabtrail.functions.timestamps import event_time, iso_timestamp
from fabtrail.plans.normalise import normalise_entries, normalise_lines
from fabtrail.sources.lines import LINE_PARSERS


def parse(spark, fmt, *lines, name="file.log"):
    df = spark.createDataFrame([(name, fmt, x) for x in lines], "source_filename string, source_format string, line string")
    return [r.asDict() for r in normalise_lines(LINE_PARSERS[fmt](df), TS).collect()]


def record(spark, text, name="a.json", **options):
    df = spark.createDataFrame([(name, "json", text)], "source_filename string, source_format string, j string")
    return normalise_entries(df.withColumn("entries", E.json_entries(F.col("j"))), TS, **options).first().asDict()


def test_text_line(spark):
    (row,) = parse(
        spark, "text", "# note", "",
        "2024-03-01T08:00:52 [ETCH-01] WRN: Alarm raised: E002 | alarm_code=E002 | recipe=ETH_SiO2_v3 | wafer=LOT4225-W10 | chuck_temp=19.88°C",
    )
    assert row["tool_id"] == "ETCH-01" and row["severity"] == "WARNING" and row["log_type"] == "alarm"
    assert (row["recipe_id"], row["wafer_id"]) == ("ETH_SiO2_v3", "LOT4225-W10")
    assert (row["parameter_name"], row["parameter_value"], row["unit"]) == ("chuck_temp", 19.88, "°C")
    assert row["event_name"] == "Alarm raised: E002"


def test_syslog_lines(spark):
    iso, bsd, plain = parse(
        spark, "syslog",
        "<132>2024-03-01 08:00:52 ETCH-01 tool_controller[1234]: Alarm raised alarm_code=E002 rf_power=350W wafer=LOT1-W2",
        "Jan  1 00:00:00 hosty proc: Temperature=5 msg error here temperature=5.5C",
        "nothing critical known",
    )
    assert iso["severity"] == "WARNING" and iso["parameter_value"] == 350.0 and iso["event_name"] == "Alarm raised"
    assert iso["alarm_code"] == "E002" and iso["timestamp"] == "2024-03-01 08:00:52"
    # a one-word name counts in lower case only, and words of an INFO line raise it
    assert bsd["timestamp"] == "Jan 1 00:00:00" and bsd["parameter_value"] == 5.5 and bsd["severity"] == "ERROR"
    assert plain["severity"] == "CRITICAL" and plain["tool_id"] == "file"


def test_kv_lines(spark):
    piped, spaced, raw = parse(
        spark, "kv", "; note", "[section]",
        'timestamp=2024-03-01T08:00:00 || tool_id=A-1 || severity=warn || event_name=Recipe began || foo=b"ar || foo=last',
        "tool_id=ETX01 pressure=5.2 severity=ERROR", "no pairs in here",
    )
    assert piped["raw_message"] == "Recipe began" and json.loads(piped["metadata"])["foo"] == "last"
    assert spaced["raw_message"].startswith("tool_id=ETX01") and json.loads(spaced["metadata"])["pressure"] == "5.2"
    assert raw["raw_message"] == "no pairs in here"
    # a recipe file loses its kind in line formats
    (recipe,) = parse(spark, "kv", "a=1 b=2", name="recipe.log")
    assert recipe["log_type"] == "info"


def test_accented_names(spark):
    (row,) = parse(spark, "kv", "température=5 tool_id=É-1 x=1")
    assert json.loads(row["metadata"])["température"] == "5" and row["tool_id"] == "É-1"


def test_structured_record(spark):
    row = record(spark, '{"foo": 1.5, "b": true, "z": null, "n": {"x": "1", "deep": {"k": [1, 2]}}, "host": null, "level": "crit"}')
    meta = json.loads(row["metadata"])
    assert meta["n_x"] == "1" and meta["n_deep_k"] == [1, 2] and meta["foo"] == 1.5 and meta["z"] is None
    assert row["raw_message"] == "n_x=1" and row["tool_id"] == "a" and row["severity"] == "CRITICAL"
    # null is missing, not a text; log type is not guessed unless asked for
    row = record(spark, '{"message": "Pump fault at lot5", "tool": null}')
    assert row["tool_id"] == "a" and row["log_type"] == "info" and row["wafer_id"] == "5"
    assert record(spark, '{"message": "Pump fault"}', classify_structured=True)["log_type"] == "alarm"
    assert record(spark, '{"message": "Wafer loaded"}', strict_wafer=True)["wafer_id"] is None
    assert record(spark, '{"message": "Wafer loaded"}')["wafer_id"] == "loaded"


def test_raw_message_of_plain_values(spark):
    assert record(spark, '{"a": 1, "b": {"c": 2.0}}')["raw_message"] == '{"a": 1, "b_c": 2.0}'


@pytest.mark.parametrize(
    "raw, iso",
    [
        ("2024-03-01 08:00:52.120Z", "2024-03-01T08:00:52.120000+00:00"),
        ("2024-03-01T08:00:52-0530", "2024-03-01T08:00:52-05:30"),
        ("03/01/2024 08:00:00", "2024-03-01T08:00:00"),
        ("Fri, 1 Mar 2024 08:00:00", "2024-03-01T08:00:00"),
        ("Mar  1 08:00:00", "2024-03-01T08:00:00"),
        ("2024-03-01", "2024-03-01T00:00:00"),
        ("2024-13-45T00:00:00", "2024-13-45T00:00:00"),
        ("soon", "soon"),
    ],
)
def test_times(spark, raw, iso):
    at = F.lit(TS)
    df = spark.createDataFrame([(raw,)], "t string")
    row = df.select(iso_timestamp(F.col("t"), at).alias("iso"), event_time(F.col("t"), at).cast("string").alias("ts")).first()
    assert row["iso"] == iso
    if raw.endswith("-0530"):
        assert row["ts"] == "2024-03-01 13:30:52"


def test_sniffing_and_guard(spark):
    cases = [
        ("a.txt", "[INFO] started tool\nmore", "text", True),
        ("a.txt", '[{"a": 1}]', "json", True),
        ("a.tsv", "a\tb", "csv", False),
        ("a", "<?xml version='1.0'?><a/>", "xml", False),
        ("a.log", "Jan  1 00:00:00 host proc: x", "syslog", False),
        ("a.log", "a=1 b=2 c=3", "kv", False),
        ("a.txt", "😀😀😀 tool_id wafer", "text", False),
        ("a.txt", "tool_id wafer ========== ░░░░", "text", False),
        ("a.exe", "tool_id wafer", "text", False),
    ]
    df = spark.createDataFrame([(n, c) for n, c, *_ in cases], "n string, c string")
    got = df.select("n", "c", sniff.sniff_format(F.col("n"), F.col("c")), sniff.admit(F.col("n"), F.col("c"))).collect()
    assert [(r[0], r[1], r[2], r[3]) for r in got] == cases


def test_masks(spark):
    df = spark.createDataFrame([("run 12 of A-1-b at -3.5C value -3.5 id 0xFF key: v9, x7",)], "m string")
    assert df.select(masking.mask_message(F.col("m"))).first()[0] == (
        "run <:NUM:> of <:EQUIPMENT_ID:> at -3.5C value <:FLOAT:> id <:HEX:> key: <:VAL:>, x7"
    )

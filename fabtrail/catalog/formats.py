"""Round trips through every format, byte-level readers, detection, guard and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fabtrail.catalog.base import LOGS_SQL, logs_from_events as logs, query, table, with_logs
from fabtrail.functions import entries as E
from fabtrail.functions import sniff
from fabtrail.functions import text as X
from fabtrail.functions.signatures import file_signature, header_fingerprint
from fabtrail.plans.ingest import ingest
from fabtrail.plans.normalise import normalise_entries, normalise_lines
from fabtrail.session import scratch_path, spread
from fabtrail.sources import binary as B
from fabtrail.sources import structured as ST
from fabtrail.sources.files import list_files
from fabtrail.sources.lines import LINE_PARSERS
from fabtrail.sources.render import MAGIC, RENDERERS, export_csv, export_json, frame_record, render, write_files, write_framed

INGEST_TS = "2024-06-01T00:00:00"

FIELDS = [
    "timestamp",
    "tool_id",
    "severity",
    "log_type",
    "event_name",
    "recipe_id",
    "wafer_id",
    "alarm_code",
    "parameter_name",
    "parameter_value",
    "unit",
    "raw_message",
    "normalized_message",
]

# what a rendered line says of a row, and what the parser makes of it, told in SQL
_LOG_TYPE = """CASE WHEN regexp_matches(lower({0}), 'alarm|fault|error|fail|critical|emergency') THEN 'alarm'
  WHEN regexp_matches(lower({0}), 'sensor|reading|measur|temperat|pressure|flow|voltage|current') THEN 'sensor_reading'
  WHEN regexp_matches(lower({0}), 'recipe|step|stage|phase|etch|deposit|clean|anneal|ramp') THEN 'process_step'
  WHEN regexp_matches(lower({0}), 'mainten|calibrat|clean|replace|inspect|pm\\b') THEN 'maintenance' ELSE 'info' END"""
_READING = "parameter_name || '=' || CAST(parameter_value AS VARCHAR) || unit"
_SHOWN = f"'[' || tool_id || '] ' || severity || ': ' || event_name || ' | ' || {_READING}"
_ALARM = "CASE WHEN alarm_code IS NOT NULL THEN '{0}alarm_code=' || alarm_code ELSE '' END"
_TEXT_LINE = f"""timestamp || ' [' || tool_id || '] ' || CASE severity WHEN 'CRITICAL' THEN 'CRT' WHEN 'ERROR' THEN 'ERR'
  WHEN 'WARNING' THEN 'WRN' ELSE 'INF' END || ': ' || event_name || {_ALARM.format(" | ")}
  || ' | recipe=' || recipe_id || ' | wafer=' || wafer_id || ' | ' || {_READING}"""
_SYSLOG_LINE = f"""event_name || {_ALARM.format(" ")} || ' ' || {_READING} || ' wafer=' || wafer_id"""


def _parsed(df: DataFrame, fmt: str) -> DataFrame:
    """Render log rows as lines of a format, parse the lines and normalise them again."""
    lines = render(spread(df), fmt).select(
        "id", "line", "source_filename", F.lit(fmt).alias("source_format")
    )
    return normalise_lines(LINE_PARSERS[fmt](lines), INGEST_TS)


@query(
    "text_round_trip",
    with_logs(
        f"""SELECT id, timestamp, tool_id, severity, {_LOG_TYPE.format("line")} AS log_type,
          'text' AS source_format, replace(event_name, ' fault', '') AS event_name, recipe_id, wafer_id, CAST(NULL AS VARCHAR) AS alarm_code,
          parameter_name, parameter_value, unit, line AS raw_message, replace({_SHOWN}, ' fault', '') AS normalized_message
        FROM (SELECT *, {_TEXT_LINE} AS line FROM logs)"""
    ),
)
def text_round_trip(spark, sf_dir):
    return _parsed(logs(spark, sf_dir), "text").select("id", "source_format", *FIELDS)


# the alarm code is cut out between two blanks
_SYSLOG_GAP = "CASE WHEN alarm_code IS NULL THEN ' ' ELSE '  ' END"


@query(
    "syslog_round_trip",
    with_logs(
        f"""SELECT id, replace(timestamp, 'T', ' ') AS timestamp, tool_id,
          CASE WHEN severity = 'INFO' AND regexp_matches(line, 'fault') THEN 'ERROR' ELSE severity END AS severity,
          {_LOG_TYPE.format("event_name || ' ' || line")} AS log_type, event_name || {_SYSLOG_GAP} || 'pressure=' || CAST(parameter_value AS VARCHAR) || unit AS event_name,
          CAST(NULL AS VARCHAR) AS recipe_id, wafer_id, alarm_code, parameter_name, parameter_value, unit,
          line AS raw_message,
          '[' || tool_id || '] ' || severity || ': ' || event_name || {_SYSLOG_GAP} || 'pressure=' || CAST(parameter_value AS VARCHAR) || unit || ' | ' || {_READING} AS normalized_message
        FROM (SELECT *, {_SYSLOG_LINE} AS line FROM logs)"""
    ),
)
def syslog_round_trip(spark, sf_dir):
    # a one-word parameter name stays part of the event text, as only names with "_" are cut
    return _parsed(logs(spark, sf_dir), "syslog").select("id", *FIELDS)


@query(
    "kv_round_trip",
    with_logs(
        f"""SELECT id, timestamp, tool_id, severity, {_LOG_TYPE.format("event_name || ' ' || event_name")} AS log_type,
          event_name, recipe_id, wafer_id, alarm_code, parameter_name, parameter_value, unit,
          event_name AS raw_message, {_SHOWN} AS normalized_message FROM logs"""
    ),
)
def kv_round_trip(spark, sf_dir):
    return _parsed(logs(spark, sf_dir), "kv").select("id", *FIELDS)


_WORDS_SQL = with_logs(
    """SELECT id, timestamp, tool_id, severity, parameter_value, line AS raw_message, CAST(k AS VARCHAR) AS k FROM (
      SELECT *, CAST(json_extract_string(metadata, '$.k') AS INTEGER) AS k,
        'timestamp=' || timestamp || ' tool_id=' || tool_id || ' severity=' || severity || ' parameter_value='
          || CAST(parameter_value AS VARCHAR) || ' k=' || json_extract_string(metadata, '$.k') AS line FROM logs)"""
)


@query("kv_words", _WORDS_SQL)
def kv_words(spark, sf_dir):
    """Blank-separated pairs; a name no field has stays in the overflow."""
    pairs = F.concat_ws(
        " ",
        F.concat(F.lit("timestamp="), "timestamp"),
        F.concat(F.lit("tool_id="), "tool_id"),
        F.concat(F.lit("severity="), "severity"),
        F.concat(F.lit("parameter_value="), X.number_text(F.col("parameter_value"))),
        F.concat(F.lit("k="), F.get_json_object("metadata", "$.k")),
    )
    lines = logs(spark, sf_dir).select(
        "id", pairs.alias("line"), "source_filename", F.lit("kv").alias("source_format")
    )
    found = normalise_lines(LINE_PARSERS["kv"](lines), INGEST_TS)
    return found.select(
        "id", "timestamp", "tool_id", "severity", "parameter_value", "raw_message",
        F.get_json_object("metadata", "$.k").alias("k"),
    )


_STRUCTURED_SQL = LOGS_SQL + f""", rec AS (
  SELECT *, event_name || CASE WHEN alarm_code IS NOT NULL THEN ' | alarm_code=' || alarm_code ELSE '' END AS csv_message,
    CASE WHEN alarm_code IS NOT NULL THEN 'alarm_code=' || alarm_code || ' | ' ELSE '' END || event_name AS message FROM logs)
SELECT {{id}} timestamp, tool_id, severity, 'info' AS log_type, event_name, recipe_id, wafer_id, alarm_code, parameter_name,
  parameter_value, unit, message AS raw_message, {_SHOWN} AS normalized_message FROM rec
"""


@query("json_round_trip", _STRUCTURED_SQL.format(id="id,"))
def json_round_trip(spark, sf_dir):
    lines = render(spread(logs(spark, sf_dir)), "json").select(
        "id", F.concat("line", F.lit(",")).alias("line"), "source_filename", F.lit("json").alias("source_format")
    )
    return normalise_entries(ST.parse_json_lines(lines), INGEST_TS).select("id", *FIELDS)


@query("json_array", _STRUCTURED_SQL.format(id="source_filename, "))
def json_array(spark, sf_dir):
    """One array per file; items that are no object are passed over."""
    rows = render(logs(spark, sf_dir), "json")
    # an array per file and hour, which bounds it
    arrays = rows.groupBy("source_filename", F.left("timestamp", F.lit(13)).alias("hour")).agg(
        F.concat(
            F.lit("[1, "), F.array_join(F.collect_list("line"), ",\n"), F.lit(', null, "text", [2]]')
        ).alias("content")
    )
    content = arrays.select("source_filename", F.lit("json").alias("source_format"), "content")
    records = ST.parse_json_arrays(content)
    return normalise_entries(records, INGEST_TS).select("source_filename", *FIELDS)


@query(
    "json_array_key_order",
    with_logs(
        """SELECT id, event_name, 'first' || id AS message, list_sort(['v', 'w']) AS unmapped, CAST(NULL AS VARCHAR) AS gone FROM logs"""
    ),
)
def json_array_key_order(spark, sf_dir):
    """Array files of many splits: members keep the order of their keys and their nulls; members that are no object are left out."""
    rows = logs(spark, sf_dir)
    record = F.concat(
        F.lit('{"id":"'), F.col("id"), F.lit('","message":"first'), F.col("id"), F.lit('","event":"'), F.col("event_name"),
        F.lit('","v":null,"w":{"a":[1,{"b":2}]}}'),
    )
    path = scratch_path(spark, "catalog-arrays") + "/arrays"
    # one file for each partition: an array that begins before and ends after the rows
    parts = spread(rows).select(F.spark_partition_id().alias("part"), F.col("id").cast("bigint").alias("n"), record.alias("line"))
    ends = parts.select("part").distinct()
    framed = (
        parts.select("part", "n", F.concat(F.lit(', 7, "x", [{"no":1}], '), "line").alias("value"))
        .unionByName(ends.select("part", F.lit(-1).cast("bigint").alias("n"), F.lit("[null").alias("value")))
        .unionByName(ends.select("part", F.lit(1 << 40).alias("n"), F.lit("]").alias("value")))
    )
    lines = framed.repartition("part").sortWithinPartitions("part", "n")
    lines.select("value", "part").write.partitionBy("part").text(path)
    found = ST.read_json_arrays(list_files(spark, path).where(F.col("source_filename").startswith("part-")))
    as_map = E.as_map(F.col("entries"))
    keys = F.transform("entries", lambda e: e["key"])
    return found.select(
        as_map["id"].alias("id"),
        as_map["event"].alias("event_name"),
        as_map["message"].alias("message"),
        F.array_sort(F.slice(keys, 4, 1 + F.size(keys))).alias("unmapped"),
        as_map["v"].alias("gone"),
    ).withColumn("unmapped", F.transform("unmapped", lambda k: F.left(k, F.lit(1))))


_EXPORT = ["id", "timestamp", "tool_id", "severity", "event_name", "parameter_value", "alarm_code", "raw_message"]
_EXPORT_SQL = with_logs(
    "SELECT id, timestamp, tool_id, severity, 'said \"' || event_name || '\", ' || tool_id AS event_name, parameter_value, alarm_code, raw_message FROM logs"
)


def _to_export(spark, sf_dir) -> DataFrame:
    quoted = F.concat(F.lit('said "'), F.col("event_name"), F.lit('", '), F.col("tool_id"))
    return logs(spark, sf_dir).withColumn("event_name", quoted).select(*_EXPORT)


@query("export_csv_files", _EXPORT_SQL)
def export_csv_files(spark, sf_dir):
    """Written as CSV with a header, read again."""
    path = scratch_path(spark, "catalog-export") + "/csv"
    rows = _to_export(spark, sf_dir)
    export_csv(rows, path)
    return spark.read.schema(rows.schema).option("escape", '"').csv(path, header=True)


@query("export_json_files", _EXPORT_SQL)
def export_json_files(spark, sf_dir):
    """Half the rows as lines of objects, half as arrays; both read again."""
    path = scratch_path(spark, "catalog-export")
    rows = _to_export(spark, sf_dir)
    odd = F.col("id").cast("bigint") % 2 == 1
    export_json(rows.where(odd), f"{path}/lines")
    export_json(rows.where(~odd), f"{path}/arrays", array=True)
    files = list_files(spark, f"{path}/arrays").where(F.col("source_filename").startswith("part-"))
    members = E.as_map(F.col("entries"))
    arrays = ST.read_json_arrays(files).select(
        *[F.try_element_at(members, F.lit(c)).cast(rows.schema[c].dataType).alias(c) for c in _EXPORT]
    )
    return spark.read.schema(rows.schema).json(f"{path}/lines").unionByName(arrays)


def _written(spark, sf_dir, fmt: str) -> str:
    path = scratch_path(spark, f"catalog-{fmt}") + f"/{fmt}"
    write_files(spread(logs(spark, sf_dir)), fmt, path)
    return path


def _data_files(spark, path: str) -> DataFrame:
    return list_files(spark, path).where(F.col("source_filename").startswith("part-"))


@query("csv_files", _STRUCTURED_SQL.format(id=""))
def csv_files(spark, sf_dir):
    """Written as CSV files, profiled, read per header and normalised."""
    path = _written(spark, sf_dir, "csv")
    heads = ST.csv_headers(ST.csv_profiles(spark, [path]))
    groups = heads.groupBy("header", "sep", "open_quotes").agg(F.count(F.lit(1)).alias("files")).collect()
    parts = [
        ST.read_csv_group(spark, [path], list(g.header), g.sep, g.open_quotes) for g in groups
    ]
    records = reduce(DataFrame.unionByName, parts).withColumn("source_format", F.lit("csv"))
    found = normalise_entries(records, INGEST_TS).select(*FIELDS)
    # an empty cell of a column is an empty text, not a missing one
    return found.withColumn("alarm_code", X.empty_to_null(F.col("alarm_code")))


@query("xml_files", _STRUCTURED_SQL.format(id=""))
def xml_files(spark, sf_dir):
    path = _written(spark, sf_dir, "xml")
    records = ST.read_xml(_data_files(spark, path)).withColumn("source_format", F.lit("xml"))
    return normalise_entries(records, INGEST_TS).select(*FIELDS)


@query(
    "xml_attributes",
    with_logs(
        """SELECT 'record' AS what, id, tool_id AS tool, 'deg' AS unit, CAST(NULL AS VARCHAR) AS message, severity AS level FROM logs
           UNION ALL SELECT 'note', id, NULL, NULL, 'seen & done', NULL FROM logs
           UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, NULL FROM logs WHERE id = '0'"""
    ),
)
def xml_attributes(spark, sf_dir):
    """Attributes of rows and of their children, rows of text only, two kinds of rows in a file, a namespace, and a file that breaks off."""
    rows = spread(logs(spark, sf_dir))
    row = F.concat(
        F.lit('<row id="'), F.col("id"), F.lit('" z:level="'), F.col("severity"), F.lit('"><reading unit="deg">7</reading><tool>'),
        F.col("tool_id"), F.lit('</tool></row>\n<note id="'), F.col("id"), F.lit('">seen &amp; done</note>'),
    )
    path = scratch_path(spark, "catalog-attributes") + "/xml"
    parts = rows.select(F.spark_partition_id().alias("part"), F.col("id").cast("bigint").alias("n"), row.alias("value"))
    ends = parts.select("part").distinct()
    framed = (
        parts.unionByName(ends.select("part", F.lit(-1).cast("bigint").alias("n"), F.lit('<?xml version="1.0"?><!-- <row> --><rows xmlns:z="urn:z">').alias("value")))
        .unionByName(ends.select("part", F.lit(1 << 40).alias("n"), F.lit("</rows>").alias("value")))
    )
    broken = spark.createDataFrame([(-1, 0, "<rows><row><tool>T</tool>")], "part int, n bigint, value string")
    lines = framed.unionByName(broken).repartition("part").sortWithinPartitions("part", "n")
    lines.select("value", "part").write.partitionBy("part").text(path)
    found = ST.read_xml(list_files(spark, path).where(F.col("source_filename").startswith("part-")))
    fields = E.as_map(F.col("entries"))
    value = lambda k: F.try_element_at(fields, F.lit(k))
    kind = F.when(F.col("error").isNotNull(), F.lit("broken")).when(value("message").isNotNull(), F.lit("note")).otherwise(F.lit("record"))
    return found.select(
        kind.alias("what"), value("id").alias("id"), value("tool").alias("tool"), value("reading_unit").alias("unit"),
        value("message").alias("message"), value("{urn:z}level").alias("level"),
    )


@query("parquet_files", _STRUCTURED_SQL.format(id=""))
def parquet_files(spark, sf_dir):
    path = _written(spark, sf_dir, "parquet")
    records = ST.read_parquet_group(spark, [path]).withColumn("source_format", F.lit("parquet"))
    return normalise_entries(records, INGEST_TS).select(*FIELDS)


@query(
    "parquet_scan",
    """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS timestamp,
         'events' AS tool_id, event_type AS event_name, value AS parameter_value, event_type || ' | props=' || props AS raw_message,
         CAST(event_id AS VARCHAR) AS event_id, 'event_id,user_id,props' AS unmapped FROM events""",
)
def parquet_scan(spark, sf_dir):
    """The events file itself as a log file."""
    records = ST.read_parquet_group(spark, [f"{sf_dir}/events.parquet"])
    found = normalise_entries(records.withColumn("source_format", F.lit("parquet")), INGEST_TS)
    names = F.from_json(F.get_json_object("metadata", "$.ai_unmapped_columns"), "array<string>")
    return found.select(
        "timestamp", "tool_id", "event_name", "parameter_value", "raw_message",
        F.get_json_object("metadata", "$.event_id").alias("event_id"),
        F.array_join(names, ",").alias("unmapped"),
    )


@query(
    "xml_layouts",
    with_logs(
        """SELECT layout, id, tool_id AS tool, CASE layout WHEN 'cdata' THEN '</event> <' || severity || '>' WHEN 'quotes' THEN 'a > b' ELSE event_name END AS note
           FROM logs, (VALUES ('header'), ('nested'), ('comment'), ('cdata'), ('quotes')) v(layout)"""
    ),
)
def xml_layouts(spark, sf_dir):
    """Header children named like fields, rows inside rows of their name, comments and CDATA that hold tags, values that hold ``>``."""
    rows = spread(logs(spark, sf_dir))
    text = lambda *parts: F.concat(*[F.lit(p) if k % 2 == 0 else F.col(p) for k, p in enumerate(parts)])
    shapes = {
        "header": text("<event><id>", "id", "</id><tool>", "tool_id", "</tool><note>", "event_name", "</note></event>"),
        "nested": text("<event><event>inner</event><id>", "id", "</id><tool>", "tool_id", "</tool><note>", "event_name", "</note></event>"),
        "comment": text("<!-- <event> > --><event><id>", "id", "</id><!-- </event> --><tool>", "tool_id", "</tool><note>", "event_name", "</note></event>"),
        "cdata": text("<event><id>", "id", "</id><tool>", "tool_id", "</tool><note><![CDATA[</event> <", "severity", ">]]></note></event>"),
        "quotes": text("<event note='a > b' id=\"", "id", "\"><tool>", "tool_id", "</tool></event>"),
    }
    root = scratch_path(spark, "catalog-layouts") + "/xml"
    lines = reduce(
        DataFrame.unionByName,
        [rows.select(F.lit(k).alias("layout"), F.spark_partition_id().alias("part"), F.col("id").cast("bigint").alias("n"), v.alias("value")) for k, v in shapes.items()],
    )
    ends = lines.select("layout", "part").distinct()
    head = ends.select("layout", "part", F.lit(-1).cast("bigint").alias("n"), F.lit("<log><note>fab 3</note>").alias("value"))
    tail = ends.select("layout", "part", F.lit(1 << 40).alias("n"), F.lit("</log>").alias("value"))
    framed = lines.unionByName(head).unionByName(tail).repartition("layout", "part").sortWithinPartitions("layout", "part", "n")
    framed.select("value", "layout", "part").write.partitionBy("layout", "part").text(root)
    found = ST.read_xml(list_files(spark, root).where(F.col("source_filename").startswith("part-")))
    fields = E.as_map(F.col("entries"))
    value = lambda k: F.try_element_at(fields, F.lit(k)).alias(k)
    layout = F.regexp_extract("source_path", "layout=([a-z]+)", 1).alias("layout")
    # the header is a child of the root too, without an id; a row that failed would be missing
    return found.select(layout, value("id"), value("tool"), value("note")).where("id IS NOT NULL")


@query(
    "csv_quoted_lines",
    with_logs("SELECT id, tool_id, event_name || chr(10) || 'said \"' || severity || '\", and more' AS message FROM logs"),
)
def csv_quoted_lines(spark, sf_dir):
    """Cells with line ends and quotes, in files that are split inside all the same."""
    path = scratch_path(spark, "catalog-quoted") + "/csv"
    said = F.concat("event_name", F.lit('\nsaid "'), "severity", F.lit('", and more'))
    rows = spread(logs(spark, sf_dir)).select("id", "tool_id", said.alias("message"))
    rows.write.option("escape", '"').csv(path, header=True)
    files = [r.source_path for r in _data_files(spark, path).select("source_path").collect()]
    found = ST.read_csv_group(spark, files, ["id", "tool_id", "message"], ",", True)
    fields = E.as_map(F.col("entries"))
    return found.select(*[F.try_element_at(fields, F.lit(c)).alias(c) for c in ("id", "tool_id", "message")])


_WITH_WARNINGS_SQL = with_logs(
    """SELECT 'rows' AS what, f AS source_format, tool_id, count(*) AS n
       FROM logs, (VALUES ('csv'), ('syslog'), ('universal')) v(f) GROUP BY ALL
       UNION ALL SELECT 'Invalid file format', NULL, NULL, 1
       UNION ALL SELECT 'XML parse error', NULL, NULL, 1
       UNION ALL SELECT 'row has too few cells', NULL, NULL, 1"""
)


@query("ingest_with_warnings", _WITH_WARNINGS_SQL)
def ingest_with_warnings(spark, sf_dir):
    """A folder with syslog, CSV and framed binary files, an image, a broken XML file and a short CSV row: rows per tool and format, and the warnings."""
    root = scratch_path(spark, "catalog-warned")
    rows = spread(logs(spark, sf_dir))
    for fmt in ("csv", "syslog"):
        write_files(rows, fmt, f"{root}/{fmt}")
    write_framed(rows, f"{root}/framed")
    odd = {"photo.png": "\x89PNG picture", "broken.xml": "<?xml version='1.0'?><a><b>pressure</c></a>", "short.csv": "timestamp,tool_id,severity,message\n2024-06-01T00:00:00,SHORT"}
    for name, text in odd.items():
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/odd/{name}")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(text.encode("latin-1")))
        out.close()
    done = ingest(spark, [f"{root}/*/part-*", f"{root}/odd/*"], ingest_ts=INGEST_TS, mine=False)
    counts = done.logs.where("tool_id <> 'SHORT'").groupBy("source_format", "tool_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = ["Invalid file format", "XML parse error", "row has too few cells"]
    kind = F.coalesce(*[F.when(F.col("warning").contains(k), F.lit(k)) for k in kinds])
    notes = done.warnings.select(kind.alias("what")).where("what IS NOT NULL").groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    return counts.select(F.lit("rows").alias("what"), "source_format", "tool_id", "n").unionByName(
        notes.select("what", none.alias("source_format"), none.alias("tool_id"), "n")
    )


_INGEST_SQL = LOGS_SQL + f"""
SELECT 'text' AS source_format, timestamp, tool_id, severity, {_LOG_TYPE.format("line")} AS log_type, replace(event_name, ' fault', '') AS event_name, wafer_id, parameter_value
  FROM (SELECT *, {_TEXT_LINE} AS line FROM logs)
UNION ALL SELECT f, timestamp, tool_id, severity, 'info', event_name, wafer_id, parameter_value
  FROM logs, (VALUES ('json'), ('csv'), ('xml'), ('parquet')) v(f)
UNION ALL SELECT 'kv', timestamp, tool_id, severity, {_LOG_TYPE.format("event_name")}, event_name, wafer_id, parameter_value FROM logs
"""


@query("ingest_mixed_files", _INGEST_SQL)
def ingest_mixed_files(spark, sf_dir):
    """Files of six formats in one folder: listed, detected, parsed and normalised."""
    root = scratch_path(spark, "catalog-mixed")
    rows = spread(logs(spark, sf_dir))
    for fmt in ("json", "csv", "xml", "parquet", "text", "kv"):
        write_files(rows, fmt, f"{root}/{fmt}")
    found = ingest(spark, f"{root}/*/part-*", ingest_ts=INGEST_TS, mine=False).logs
    return found.select(
        "source_format", "timestamp", "tool_id", "severity", "log_type", "event_name", "wafer_id", "parameter_value"
    )


# -- rendering ------------------------------------------------------------------------------------

_RENDER_SQL = LOGS_SQL + f"""
SELECT id, 'text' AS format, {_TEXT_LINE} AS line FROM logs
UNION ALL SELECT id, 'syslog', '<' || CAST(128 + CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 4
  ELSE 6 END AS VARCHAR) || '>' || replace(timestamp, 'T', ' ') || ' ' || tool_id || ' tool_controller[1234]: ' || {_SYSLOG_LINE} FROM logs
UNION ALL SELECT id, 'kv', concat_ws(' || ', 'timestamp=' || timestamp, 'tool_id=' || tool_id, 'severity=' || severity,
  'recipe_id=' || recipe_id, 'wafer_id=' || wafer_id, 'alarm_code=' || alarm_code, 'event_name=' || event_name,
  'parameter_name=' || parameter_name, 'parameter_value=' || CAST(parameter_value AS VARCHAR), 'unit=' || unit) FROM logs
UNION ALL SELECT id, 'csv', timestamp || ',' || tool_id || ',' || severity || ',' || recipe_id || ',' || wafer_id || ',,'
  || coalesce(alarm_code, '') || ',' || event_name || ',' || parameter_name || ',' || CAST(parameter_value AS VARCHAR) || ',' || unit FROM logs
UNION ALL SELECT id, 'xml', '<LogEntry><timestamp>' || timestamp || '</timestamp><tool_id>' || tool_id || '</tool_id><severity>' || severity
  || '</severity><recipe_id>' || recipe_id || '</recipe_id><wafer_id>' || wafer_id || '</wafer_id><process_stage></process_stage><alarm_code>'
  || coalesce(alarm_code, '') || '</alarm_code><event_name>' || event_name || '</event_name><parameter_name>' || parameter_name
  || '</parameter_name><parameter_value>' || CAST(parameter_value AS VARCHAR) || '</parameter_value><unit>' || unit || '</unit></LogEntry>' FROM logs
"""


@query("render_lines", _RENDER_SQL)
def render_lines(spark, sf_dir):
    rows = logs(spark, sf_dir)
    shapes = F.array(
        *[
            F.struct(F.lit(fmt).alias("format"), RENDERERS[fmt](rows).alias("line"))
            for fmt in ("text", "syslog", "kv", "csv", "xml")
        ]
    )
    return rows.select("id", F.inline(shapes))


# -- bytes ------------------------------------------------------------------------------------------

_PAIRS_SQL = """concat_ws(' | ', 'timestamp=' || timestamp, 'tool_id=' || tool_id, 'severity=' || severity, 'recipe_id=' || recipe_id,
  'wafer_id=' || wafer_id, 'alarm_code=' || alarm_code, 'event_name=' || event_name, 'parameter_name=' || parameter_name,
  'parameter_value=' || CAST(parameter_value AS VARCHAR), 'unit=' || unit)"""
_FRAMES_SQL = with_logs(
    """SELECT id, n AS "row", timestamp, tool_id, severity, event_name, wafer_id, alarm_code, event_name AS raw_message
    FROM logs, (VALUES (0::BIGINT), (1::BIGINT)) v(n)"""
)


def _record_columns(records: DataFrame) -> DataFrame:
    found = records.withColumn("_f", E.as_map(F.col("entries")))
    names = ["timestamp", "tool_id", "severity", "event_name", "wafer_id", "alarm_code", "raw_message"]
    return found.select("id", "row", *[F.try_element_at("_f", F.lit(n)).alias(n) for n in names])


@query("framed_binary", _FRAMES_SQL)
def framed_binary(spark, sf_dir):
    """Two frames behind the magic bytes, found and walked."""
    rows = spread(logs(spark, sf_dir))
    frame = frame_record(rows)
    content = F.concat(F.lit(MAGIC), frame, frame)
    return _record_columns(B.decode_content(rows.select("id", content.alias("content"))))


@query("nul_separated_pairs", _FRAMES_SQL)
def nul_separated_pairs(spark, sf_dir):
    """Two records between NUL bytes; the second starts where the time comes again."""
    rows = spread(logs(spark, sf_dir))
    frame = frame_record(rows)
    payload = F.substring(frame, F.lit(5), F.octet_length(frame))
    content = F.concat(F.unhex(F.lit("FFFE00")), payload, F.unhex(F.lit("00")), payload)
    return _record_columns(B.decode_content(rows.select("id", content.alias("content"))))


@query(
    "frame_payload",
    with_logs(
        f"""SELECT id, strlen(replace({_PAIRS_SQL}, ' | ', '0')) AS size, {_PAIRS_SQL} AS pairs, event_name AS raw_message FROM logs"""
    ),
)
def frame_payload(spark, sf_dir):
    """Length and pairs of single frames, read by expressions alone."""
    rows = spread(logs(spark, sf_dir))
    rows = rows.withColumn("_frame", frame_record(rows))
    payload = F.substring(F.col("_frame"), F.lit(5), F.octet_length("_frame"))
    found = rows.select(
        "id",
        X.le_u32(F.col("_frame"), F.lit(1)).alias("size"),
        B.payload_entries(payload).alias("entries"),
    )
    joined = F.transform("entries", lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select(
        "id", "size", F.array_join(joined, " | ").alias("pairs"),
        B.message_of(F.col("entries")).alias("raw_message"),
    )


@query(
    "message_of_pairs",
    with_logs(f"""SELECT id, CASE WHEN severity = 'INFO' THEN event_name ELSE replace({_PAIRS_SQL}, ' | event_name=' || event_name, '') END AS raw_message FROM logs"""),
)
def message_of_pairs(spark, sf_dir):
    rows = spread(logs(spark, sf_dir)).withColumn(
        "event_name", F.when(F.col("severity") == "INFO", F.col("event_name"))
    )
    frame = frame_record(rows)
    payload = F.substring(frame, F.lit(5), F.octet_length(frame))
    found = rows.select("id", B.payload_entries(payload).alias("entries"))
    return found.select("id", B.message_of(F.col("entries")).alias("raw_message"))


_HEX_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(text))) AS h FROM documents),
chunks AS (SELECT doc_id, i AS "row", substr(h, CAST(i * 32 + 1 AS BIGINT), 32) AS c
  FROM d, LATERAL (SELECT unnest(range(0, (strlen(h) + 31) // 32)) AS i))
"""


@query("hex_rows", _HEX_SQL + """SELECT doc_id, "row", rtrim(regexp_replace(c, '(..)', '\\1 ', 'g')) AS raw_message FROM chunks""")
def hex_rows(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return B.hex_rows(docs.select("doc_id", F.encode("text", "UTF-8").alias("content")))


@query(
    "hex_dump",
    _HEX_SQL
    + """SELECT doc_id, lpad(lower(hex("row" * 16)), 8, '0') || '  ' || rpad(rtrim(regexp_replace(c, '(..)', '\\1 ', 'g')), 48, ' ') || '  |'
      || list_aggregate(list_transform(range(0, strlen(c) // 2), lambda p: CASE WHEN substr(c, CAST(p * 2 + 1 AS BIGINT), 2) BETWEEN '20' AND '7e'
        THEN chr(CAST('0x' || substr(c, CAST(p * 2 + 1 AS BIGINT), 2) AS INTEGER)) ELSE '.' END), 'string_agg', '') || '|' AS line FROM chunks""",
)
def hex_dump(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    data = F.encode("text", "UTF-8")
    return docs.select(
        "doc_id", F.explode(B.content_sample(data, None)).alias("line")
    )


@query(
    "raw_lines",
    """SELECT doc_id, CAST(n - 1 AS INTEGER) AS "row", trim(line, ' \t') AS raw_message FROM (
         SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM (
           SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS lines FROM documents))
       WHERE trim(line, ' \t') <> ''""",
)
def raw_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return B.raw_lines(docs)


@query(
    "printable_strings",
    """SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '[\\x20-\\x7e]{4,}'), 1, 50), '~') AS found FROM documents""",
)
def printable_strings(spark, sf_dir):
    found = X.printable_strings(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(found, "~").alias("found")
    )


# -- detection, guard, fingerprints -------------------------------------------------------------------

# the first n bytes of a text as text, without a character cut in two
_HEAD = """decode(unhex(regexp_replace(substr(hex(encode({0})), 1, {1}), '^((?:..)*?)(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){{0,2}})$', '\\1')))"""
_BARE = "trim({0}, ' \t\n\r')"
_SYSLOG_SQL = r"""(regexp_matches(left({0}, 2000), '(?m)^(?:<\d+>)?\w{{3}}\s+\d+\s+\d{{2}}:\d{{2}}:\d{{2}}')
  OR regexp_matches(left({0}, 2000), '(?m)^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}.*\w+\[\d+\]:')
  OR regexp_matches(left({0}, 2000), '(?m)^(?:<\d+>)?\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+\S+\s+\S+\[\d+\]:'))"""
_CSV_SQL = r"""coalesce((SELECT max(c) > 0 AND count(DISTINCT c) <= 2 FROM (SELECT length(l) - length(replace(l, ',', '')) AS c FROM (
  SELECT unnest(list_slice(list_filter(regexp_split_to_array({0}, '\r\n|[\n\r]'), lambda x: trim(x, ' \t') <> ''), 1, 5)) AS l))), false)"""
_TEXT_SQL = r"""len(list_filter(list_slice(list_filter(regexp_split_to_array(left({0}, 2000), '\r\n|[\n\r]'),
  lambda x: trim(x, ' \t') <> '' AND NOT starts_with(x, '#')), 1, 10),
  lambda x: regexp_matches(x, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}\s+\['))) >= 2"""
_KV_SQL = r"""len(regexp_extract_all(left({0}, 1000), '[\pL\pN_.\-]+\s*=\s*\S+')) >= 3"""


def _named_documents(spark, sf_dir) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text"
    )


@query(
    "looks_like",
    f"""SELECT doc_id, {_SYSLOG_SQL.format("t")} AS syslog, {_CSV_SQL.format("t")} AS csv, {_KV_SQL.format("t")} AS kv,
      {_TEXT_SQL.format("t")} AS text_log FROM (SELECT doc_id, {_HEAD.format("text", 8192)} AS t FROM documents)""",
)
def looks_like(spark, sf_dir):
    head = _named_documents(spark, sf_dir).select("doc_id", sniff.head_text(F.col("text")).alias("t"))
    t = F.col("t")
    return head.select(
        "doc_id",
        sniff.looks_like_syslog(t).alias("syslog"),
        sniff.looks_like_csv(t).alias("csv"),
        sniff.looks_like_kv(t).alias("kv"),
        sniff.looks_like_text_log(t).alias("text_log"),
    )


_SNIFF_SQL = f"""CASE WHEN starts_with(b, '{{{{') OR regexp_matches(b, '^\\[\\s*(?:\\{{{{|\\]|$)') THEN 'json'
  WHEN starts_with(b, '<') AND contains(lower(left(b, 100)), 'xml') THEN 'xml'
  WHEN {_SYSLOG_SQL.format("b")} THEN 'syslog' WHEN {_CSV_SQL.format("b")} THEN 'csv'
  WHEN {_TEXT_SQL.format("b")} THEN 'text' WHEN {_KV_SQL.format("b")} THEN 'kv' ELSE 'text' END"""
_SNIFF_SQL = _SNIFF_SQL.replace("{{", "{").replace("}}", "}")


@query(
    "sniff_documents",
    f"""SELECT doc_id, {_SNIFF_SQL} AS format FROM (SELECT doc_id, {_BARE.format(_HEAD.format("text", 8192))} AS b FROM documents)""",
)
def sniff_documents(spark, sf_dir):
    docs = _named_documents(spark, sf_dir)
    return docs.select("doc_id", sniff.sniff_format(F.col("name"), F.col("text")).alias("format"))


@query(
    "sniff_pages",
    f"""SELECT page_id, {_SNIFF_SQL} AS format FROM (SELECT page_id, {_BARE.format(_HEAD.format("html", 8192))} AS b FROM pages)""",
)
def sniff_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    return pages.select("page_id", sniff.sniff_format(name, F.col("html")).alias("format"))


_RENDERED_SQL = LOGS_SQL + f""", shapes AS (
  SELECT tool_id, 'text' AS shape, 'log' AS ext, 'text' AS format FROM logs GROUP BY tool_id HAVING count(*) >= 2
  UNION ALL SELECT tool_id, 'text', 'log', 'kv' FROM logs GROUP BY tool_id HAVING count(*) = 1
  UNION ALL SELECT tool_id, 'syslog', 'log', 'syslog' FROM logs GROUP BY tool_id
  UNION ALL SELECT tool_id, 'kv', 'log', 'kv' FROM logs GROUP BY tool_id
  UNION ALL SELECT tool_id, 'json', 'txt', 'json' FROM logs GROUP BY tool_id
  UNION ALL SELECT tool_id, 'xml', 'dat', 'llm' FROM logs GROUP BY tool_id
  UNION ALL SELECT tool_id, 'csv', 'csv', 'csv' FROM logs GROUP BY tool_id)
SELECT tool_id, shape, format, true AS admitted FROM shapes
"""


@query("sniff_rendered", _RENDERED_SQL)
def sniff_rendered(spark, sf_dir):
    """The first lines of each tool in several formats, under several extensions."""
    rows = spread(logs(spark, sf_dir))
    extensions = {"text": "log", "syslog": "log", "kv": "log", "json": "txt", "xml": "dat", "csv": "csv"}
    shapes = F.array(
        *[
            F.struct(F.lit(s).alias("shape"), F.lit(x).alias("ext"), RENDERERS[s](rows).alias("line"))
            for s, x in extensions.items()
        ]
    )
    lines = rows.select("tool_id", F.col("id").cast("bigint").alias("n"), F.inline(shapes))
    # the least two lines make a head; min keeps one value per task, not a group
    first = F.min(F.struct("n", "line"))
    least = lines.groupBy("tool_id", "shape", "ext").agg(
        first.alias("a"), F.max(F.struct("n", "line")).alias("b"), F.count(F.lit(1)).alias("rows")
    )
    content = F.when(F.col("rows") > 1, F.concat("a.line", F.lit("\n"), "b.line")).otherwise(F.col("a.line"))
    name = F.concat("tool_id", F.lit("."), "ext")
    return least.select(
        "tool_id",
        "shape",
        sniff.sniff_format(name, content).alias("format"),
        sniff.admit(name, content).alias("admitted"),
    )


def _sql_words(patterns: list[str], text: str) -> str:
    """The patterns over a lower-cased text, with word ends that know accented letters."""
    terms = []
    for p in patterns:
        lead = p.startswith(r"\b")
        tail = p.endswith(r"\b")
        body = p[2:] if lead else p
        body = body[:-2] if tail else body
        sql = ("(?:^|[^\\pL\\pN_])" if lead else "") + "(?:" + body + ")" + ("(?:$|[^\\pL\\pN_])" if tail else "")
        terms.append(f"CAST(regexp_matches({text}, '{sql}') AS INTEGER)")
    return " + ".join(terms)


_ART = [p.replace("'", "''") for p in sniff.DECORATIONS]
_EMOTICONS = "[:;][''\\-]?[)(DPp/\\\\|]|[<>]3|xD|XD|¯\\\\?_\\(ツ\\)_/¯"
_MARKS = " OR ".join(f"regexp_matches(s, '(?i){p}')" for p in sniff.DATA_MARKERS)
_GUARD_SQL = f"""
WITH h AS (SELECT doc_id, {_HEAD.format("text", 2048)} AS s, lower({_HEAD.format("text", 8192)}) AS w FROM documents),
c AS (SELECT doc_id, s, len(regexp_extract_all(s, '[\\x{{10000}}-\\x{{10ffff}}]')) AS emoji, len(regexp_extract_all(s, '{_EMOTICONS}')) AS faces,
  {_sql_words(_ART, "s")} AS art, {_sql_words(sniff.DOMAIN_WORDS, "w")} AS words, ({_MARKS}) AS marked FROM h)
SELECT doc_id, CAST(emoji AS INTEGER) AS emoji, CAST(faces AS INTEGER) AS faces, art, words,
  CASE WHEN emoji > 2 OR faces > 5 OR art >= 2 THEN false WHEN words >= 2 THEN true ELSE marked END AS admitted FROM c
"""


@query("guard_documents", _GUARD_SQL)
def guard_documents(spark, sf_dir):
    docs = _named_documents(spark, sf_dir)
    sample, wide = sniff.head_text(F.col("text"), 1024), sniff.head_text(F.col("text"))
    return docs.select(
        "doc_id",
        sniff.emoji_count(sample).alias("emoji"),
        sniff.emoticon_count(sample).alias("faces"),
        sniff.decoration_hits(sample).alias("art"),
        sniff.domain_hits(wide).alias("words"),
        sniff.admit(F.col("name"), F.col("text")).alias("admitted"),
    )


@query(
    "guard_by_extension",
    """SELECT doc_id, name, CASE WHEN ext IN ('png', 'zip') THEN false ELSE true END AS admitted FROM (
      SELECT doc_id, 'file_' || CAST(doc_id AS VARCHAR) || '.' || ext AS name, ext FROM (
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'ZIP' WHEN 2 THEN 'log' ELSE 'bin' END AS e, lower(e) AS ext FROM documents))""",
)
def guard_by_extension(spark, sf_dir):
    """Log text under accepted and rejected extensions."""
    docs = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("png", "zip", "log", "bin")]), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("file_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    content = F.concat(F.lit("tool_id=A-1 pressure=5 wafer=LOT1 "), F.unhex(F.lit("00")).cast("string"), "text")
    return docs.select("doc_id", name.alias("name"), sniff.admit(name, content).alias("admitted"))


@query(
    "file_signatures",
    """SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'txt' ELSE 'unknown' END || ':' || left(md5(unhex(substr(hex(encode(text)), 1, 8192))), 12) AS signature FROM documents""",
)
def file_signatures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc"), F.when(F.col("doc_id") % 2 == 0, F.lit(".TXT")).otherwise(F.lit("")))
    return docs.select("doc_id", file_signature(name, F.col("text")).alias("signature"))


@query(
    "header_fingerprints",
    """SELECT doc_id, sha256(array_to_string(list_sort(list_transform(string_split(lower(text), ' '), lambda x: x)), '|')) AS fingerprint FROM documents""",
)
def header_fingerprints(spark, sf_dir):
    """The words of each text taken as column names."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", header_fingerprint(F.split("text", " ")).alias("fingerprint"))


@query(
    "file_names",
    """SELECT page_id, CASE WHEN contains(n, '.') THEN lower(regexp_extract(n, '[^.]*$')) ELSE '' END AS extension,
         regexp_replace(n, '\\.[^.]*$', '') AS stem FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS n FROM pages)""",
)
def file_names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", X.base_name(F.col("url")).alias("n"))
    return pages.select("page_id", X.extension(F.col("n")).alias("extension"), X.stem(F.col("n")).alias("stem"))

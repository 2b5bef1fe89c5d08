"""The rules of normalisation, one by one, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabtrail import schema as S
from fabtrail.catalog.base import logs_from_events as logs, query, table, with_logs
from fabtrail.catalog.formats import INGEST_TS, _sql_words
from fabtrail.functions import entries as E
from fabtrail.functions import rules as R
from fabtrail.functions import text as X
from fabtrail.functions.timestamps import event_time, iso_timestamp
from fabtrail.operators import aggregates as A, headers as H
from fabtrail.operators.lookups import match_headers
from fabtrail.plans import normalise as N
from fabtrail.plans.review import remap
from fabtrail.session import spread, stored


def _pick(options: list[str], number):
    """One of several texts by a number, to vary the input."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (number % len(options) + 1).cast("int"))


def _sql_pick(options: list[str], number: str) -> str:
    listed = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"([{listed}])[{number} % {len(options)} + 1]"


_LEVELS = ["Debug", " dbg", "TRACE", "info", "Notice ", "WARN", "wrn", "Caution", "err", "Failure", "FAULT", "fatal", "Severe", "emerg", "crit", "unheard", ""]
_LEVELS_OUT = ["DEBUG"] * 3 + ["INFO"] * 2 + ["WARNING"] * 3 + ["ERROR"] * 3 + ["CRITICAL"] * 4 + ["INFO"] * 2


@query(
    "severity_words",
    f"SELECT event_id, {_sql_pick(_LEVELS_OUT, 'event_id')} AS severity FROM events",
)
def severity_words(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", R.severity_of(_pick(_LEVELS, F.col("event_id"))).alias("severity"))


_NAMES = ["Temp_1", "Pressure(Torr)", "flowMeter", "power", "VOLTAGE", "currents", "speed", "rpm2", "Humidity", "vacuum", "RF forward", "gas3", "chuck left temp", "process total time", " Other "]
_NAMES_OUT = ["temperature", "pressure", "flow_rate", "power", "voltage", "current", "speed", "rotation_speed", "humidity", "vacuum_level", "rf_power", "gas_flow", "chuck_temperature", "process_time", "other"]


@query("parameter_names", f"SELECT event_id, {_sql_pick(_NAMES_OUT, 'event_id')} AS name FROM events")
def parameter_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", R.parameter_name_of(_pick(_NAMES, F.col("event_id"))).alias("name"))


_TIME_IN = [
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "yyyyMMddHHmmss",
    "dd MMM yyyy HH:mm:ss",
    "MMM d, yyyy HH:mm:ss",
]


@query(
    "timestamps_to_iso",
    """SELECT event_id, CASE event_id % 10 WHEN 7 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 8 THEN 'no time ' || event_id
         WHEN 9 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END
         ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS iso,
       CASE event_id % 10 WHEN 8 THEN NULL WHEN 9 THEN ts ELSE date_trunc('second', ts) END AS event_ts FROM events""",
)
def timestamps_to_iso(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    form = F.col("event_id") % 10
    raw = F.when(form == 7, F.date_format("ts", "yyyy-MM-dd HH:mm:ss'Z'"))
    raw = raw.when(form == 8, F.concat(F.lit("no time "), F.col("event_id").cast("string")))
    raw = raw.when(form == 9, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    for i, pattern in enumerate(_TIME_IN):
        raw = raw.when(form == i, F.date_format("ts", pattern))
    e = e.withColumn("raw", raw)
    at = F.lit(INGEST_TS)
    return e.select(
        "event_id", iso_timestamp(F.col("raw"), at).alias("iso"), event_time(F.col("raw"), at).alias("event_ts")
    )


_FREE_TIMES = [
    "M/d/yyyy h:mm:ss a", "MMMM d, yyyy HH:mm:ss", "MM-dd-yyyy HH:mm:ss", "d MMMM yyyy hh:mm:ss a", "M/d/yyyy H:mm:ss'Z'",
    "EEEE, MMMM d, yyyy h:mm:ss a", "yyyy-MM-dd hh:mm:ss a", "d-MMM-yyyy HH:mm:ss '+00:00'", "MMM d yyyy HH:mm:ss 'UTC'",
]


@query(
    "timestamps_free_form",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 10 IN (4, 7, 8) THEN '+00:00' WHEN event_id % 10 = 9 THEN '-02:30' ELSE '' END AS iso,
         date_trunc('second', ts) + CASE WHEN event_id % 10 = 9 THEN INTERVAL 150 MINUTE ELSE INTERVAL 0 MINUTE END AS event_ts FROM events""",
)
def timestamps_free_form(spark, sf_dir):
    """Halves of the day, long names, dashes, weekdays, and offsets behind a time."""
    e = table(spark, sf_dir, "events")
    form = F.col("event_id") % 10
    raw = F.when(form == 9, F.concat(F.upper(F.date_format("ts", "MMMM d, yyyy h:mm:ss a")), F.lit(" -0230")))
    for i, pattern in enumerate(_FREE_TIMES):
        raw = raw.when(form == i, F.date_format("ts", pattern))
    at = F.lit(INGEST_TS)
    e = e.withColumn("raw", raw)
    return e.select(
        "event_id", iso_timestamp(F.col("raw"), at).alias("iso"), event_time(F.col("raw"), at).alias("event_ts")
    )


@query(
    "numbers_from_text",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 1500.0 ELSE -value END AS number FROM events""",
)
def numbers_from_text(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    plain = X.number_text(F.col("value"))
    form = F.col("event_id") % 6
    raw = (
        F.when(form == 0, plain)
        .when(form == 1, F.concat(F.lit(" "), plain, F.lit("\t")))
        .when(form == 2, F.concat(plain, F.lit("d")))
        .when(form == 3, F.lit("n/a"))
        .when(form == 4, F.lit("1_5e2"))
        .otherwise(F.concat(F.lit("-"), plain))
    )
    return e.select("event_id", X.to_number(raw).alias("number"))


@query(
    "numbers_to_text",
    """SELECT event_id, CAST(value * p AS VARCHAR) AS number FROM (SELECT event_id, value, ([1.0, 1e6, 1e-6, 1e16, 1e-3])[event_id % 5 + 1]::DOUBLE AS p FROM events)""",
)
def numbers_to_text(spark, sf_dir):
    scale = F.element_at(F.array(*[F.lit(x) for x in (1.0, 1e6, 1e-6, 1e16, 1e-3)]), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", X.number_text(F.col("value") * scale).alias("number"))


_TYPE_SQL = " ".join(
    f"WHEN {_sql_words(pattern.split('|'), 'lower(text)')} > 0 THEN '{name}'" for name, pattern in S.LOG_TYPE_PATTERNS.items()
)


@query("log_type_of_text", f"SELECT doc_id, CASE {_TYPE_SQL} ELSE 'info' END AS log_type FROM documents")
def log_type_of_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.log_type_of(F.col("text")).alias("log_type"))


_RAISE_SQL = " ".join(
    f"WHEN {_sql_words([chr(92) + 'b' + word + chr(92) + 'b'], 'lower(t)')} > 0 THEN '{level}'" for word, level in S.PROMOTION_WORDS.items()
)


@query(
    "severity_raised_by_text",
    f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'DEBUG' {_RAISE_SQL} ELSE 'INFO' END AS severity FROM (
      SELECT conv_id, turn, text || {_sql_pick([' alert', ' errors', ' Fault', ' warning', ' WARN!', ''], 'conv_id')} AS t FROM conversations)""",
)
def severity_raised_by_text(spark, sf_dir):
    """Whole words raise INFO, "errors" and "warning" do not."""
    c = table(spark, sf_dir, "conversations")
    t = F.concat("text", _pick([" alert", " errors", " Fault", " warning", " WARN!", ""], F.col("conv_id")))
    stated = F.when(F.col("turn") % 3 == 1, F.lit("DEBUG")).otherwise(F.lit("INFO"))
    return c.select("conv_id", "turn", R.promoted_severity(stated, t).alias("severity"))


@query(
    "syslog_priorities",
    """SELECT event_id, CASE WHEN event_id % 200 >= 192 THEN 'INFO' ELSE (['CRITICAL','CRITICAL','CRITICAL','ERROR','WARNING','INFO','INFO','DEBUG'])[event_id % 200 % 8 + 1] END AS severity FROM events""",
)
def syslog_priorities(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 200
    return e.select("event_id", R.syslog_severity(F.when(n < 192, n.cast("string"))).alias("severity"))


# -- whole records ----------------------------------------------------------------------------------


def _records(df, entries):
    return spread(df).select(
        "id", "source_filename", F.lit("json").alias("source_format"), entries.alias("entries")
    )


@query(
    "alias_resolution",
    with_logs(
        """SELECT id, timestamp, tool_id, severity, 'User msg' AS event_name, 'b' AS recipe_id, wafer_id, 'load' AS process_stage,
             'temperature' AS parameter_name, parameter_value, unit, 'first | User msg | custom=' || id AS raw_message, id AS custom FROM logs"""
    ),
)
def alias_resolution(spark, sf_dir):
    """Columns named in other ways; the last of two for one field wins, the first for the tool."""
    rows = logs(spark, sf_dir)
    text = lambda name, col: E.text_entry(F.lit(name), col)
    entries = F.array(
        text("Log_Time", F.col("timestamp")),
        text(" MACHINE ", F.col("tool_id")),
        text("host", F.lit("other")),
        text("Level", F.lower("severity")),
        text("step", F.lit("first")),
        text("msg", F.lit("User msg")),
        text("job", F.lit("a")),
        text("Process_Recipe", F.lit("b")),
        text("lot", F.col("wafer_id")),
        text("phase", F.lit("load")),
        text("sensor", F.lit("Temp 1")),
        E.entry(F.lit("val"), X.number_text(F.col("parameter_value")), F.lit("N")),
        text("uom", F.col("unit")),
        text("custom", F.col("id")),
        E.entry(F.lit("number"), F.lit("5"), F.lit("N")),
    )
    found = N.normalise_entries(_records(rows, entries), INGEST_TS)
    return found.select(
        "id", "timestamp", "tool_id", "severity", "event_name", "recipe_id", "wafer_id", "process_stage",
        "parameter_name", "parameter_value", "unit", "raw_message",
        F.get_json_object("metadata", "$.custom").alias("custom"),
    )


@query(
    "fields_from_text",
    with_logs(
        """SELECT id, replace(source_filename, '.log', '') AS tool_id, 'INFO' AS severity, 'pressure' AS parameter_name, parameter_value, 'Torr' AS unit,
             'lot' || regexp_extract(wafer_id, '[0-9]+') AS wafer_id, CAST(regexp_extract(tool_id, '[0-9]+') AS INTEGER) AS step_number,
             '2024-06-01T00:00:00' AS timestamp FROM logs"""
    ),
)
def fields_from_text(spark, sf_dir):
    """Tool, time, reading, wafer and step that no column names."""
    rows = logs(spark, sf_dir)
    digits = lambda c: F.regexp_extract(c, "[0-9]+", 0)
    event = F.concat(
        F.lit("Step no "), digits("tool_id"), F.lit(" wafer=LOT"), digits("wafer_id"),
        F.lit(" Pressure: "), X.number_text(F.col("parameter_value")), F.lit(" Torr"),
    )
    found = N.normalise_entries(_records(rows, F.array(E.text_entry(F.lit("message"), event))), INGEST_TS)
    return found.select(
        "id", "tool_id", "severity", "parameter_name", "parameter_value", "unit", "wafer_id", "step_number", "timestamp"
    )


@query(
    "tool_from_event",
    with_logs("SELECT id, tool_id FROM logs"),
)
def tool_from_event(spark, sf_dir):
    """A record without a file name takes the tool its event names."""
    rows = logs(spark, sf_dir).withColumn("source_filename", F.lit(""))
    event = F.concat(F.lit("Fault on "), F.col("tool_id"), F.lit(" now"))
    return N.normalise_entries(
        _records(rows, F.array(E.text_entry(F.lit("event"), event))), INGEST_TS
    ).select("id", "tool_id")


@query(
    "recipe_files",
    with_logs(
        """SELECT id, 'recipe' AS log_type, CASE WHEN severity = 'INFO' THEN 'UNKNOWN' ELSE recipe_id END AS recipe_id,
             CASE WHEN log_type = 'alarm' THEN 'UNKNOWN' ELSE 'temperature' END AS setpoint_name, parameter_value AS setpoint_value FROM logs"""
    ),
)
def recipe_files(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumn("source_filename", F.lit("My_Recipe.json"))
    entries = F.concat(
        F.array(E.entry(F.lit("value"), X.number_text(F.col("parameter_value")), F.lit("N"))),
        F.when(F.col("severity") != "INFO", F.array(E.text_entry(F.lit("recipe"), F.col("recipe_id")))).otherwise(E.empty_entries()),
        F.when(F.col("log_type") != "alarm", F.array(E.text_entry(F.lit("param"), F.lit("temp")))).otherwise(E.empty_entries()),
    )
    found = N.normalise_entries(_records(rows, entries), INGEST_TS)
    return found.select(
        "id", "log_type", "recipe_id",
        F.get_json_object("metadata", "$.setpoint_name").alias("setpoint_name"),
        F.get_json_object("metadata", "$.setpoint_value").cast("double").alias("setpoint_value"),
    )


@query(
    "nested_json",
    with_logs(
        """SELECT id, tool_id, parameter_value, '1' AS sensor_value_raw, '[1,2]' AS list,
             'sensor_label=p | deep_er_k=' || json_extract_string(metadata, '$.k') || ' | sensor_value_raw=1' AS raw_message FROM logs"""
    ),
)
def nested_json(spark, sf_dir):
    """Nested objects become columns with joined names; lists stay values."""
    rows = logs(spark, sf_dir)
    doc = F.concat(
        F.lit('{"tool_id":"'), F.col("tool_id"), F.lit('","sensor":{"value":'),
        X.number_text(F.col("parameter_value")), F.lit(',"list":[1,2],"label":"p"},"deep":{"er":{"k":"'),
        F.get_json_object("metadata", "$.k"), F.lit('"}},"none":{},"sensor_value":{"raw":"1"},"t":true,"z":null}'),
    )
    found = N.normalise_entries(_records(rows, E.json_entries(doc)), INGEST_TS)
    return found.select(
        "id", "tool_id", "parameter_value",
        F.get_json_object("metadata", "$.sensor_value_raw").alias("sensor_value_raw"),
        F.get_json_object("metadata", "$.sensor_list").alias("list"),
        "raw_message",
    )


@query(
    "nested_json_deep",
    with_logs(
        """SELECT id, 'a_b_c_d_e_f_g_h_i_j_k_l' AS key, event_name AS value FROM logs
           UNION ALL SELECT id, 'a_b_c_x', '1' FROM logs UNION ALL SELECT id, 'y', tool_id FROM logs"""
    ),
)
def nested_json_deep(spark, sf_dir):
    """Objects twelve levels deep are unfolded to the end."""
    rows = logs(spark, sf_dir)
    deep = F.concat(F.lit('{"l":"'), F.col("event_name"), F.lit('"}'))
    for name in "kjihgfed":
        deep = F.concat(F.lit('{"' + name + '":'), deep, F.lit("}"))
    doc = F.concat(F.lit('{"a":{"b":{"c":{"x":1,'), F.substring(deep, F.lit(2), F.length(deep)), F.lit("}},\"y\":\""), F.col("tool_id"), F.lit('"}'))
    found = rows.select("id", F.explode(E.json_entries(doc)).alias("e"))
    return found.select("id", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


@query(
    "metadata_fields",
    with_logs(
        """SELECT id, event_name, wafer_id, CAST(parameter_value AS DOUBLE) AS parameter_value, json_extract_string(metadata, '$.k') AS k,
             '"quoted" \\ ' || tool_id AS note FROM logs"""
    ),
)
def metadata_fields(spark, sf_dir):
    """What the overflow JSON holds reads back as it was."""
    rows = logs(spark, sf_dir)
    entries = F.array(
        E.text_entry(F.lit("event"), F.col("event_name")),
        E.text_entry(F.lit("lot"), F.col("wafer_id")),
        E.entry(F.lit("value"), X.number_text(F.col("parameter_value")), F.lit("N")),
        E.entry(F.lit("k"), F.get_json_object("metadata", "$.k"), F.lit("N")),
        E.text_entry(F.lit("note"), F.concat(F.lit('"quoted" \\ '), F.col("tool_id"))),
    )
    found = N.normalise_entries(_records(rows, entries), INGEST_TS)
    value = lambda k: F.try_variant_get(F.parse_json("metadata"), f"$.{k}", "string").alias(k)
    return found.select(
        "id", value("event_name"), value("wafer_id"),
        F.try_variant_get(F.parse_json("metadata"), "$.parameter_value", "double").alias("parameter_value"),
        value("k"), value("note"),
    )


@query(
    "missing_fields",
    with_logs(
        """SELECT id, trim(CASE WHEN severity = 'INFO' THEN 'tool_id ' ELSE '' END || CASE WHEN log_type = 'alarm' THEN 'raw_message' ELSE '' END) AS missing FROM logs"""
    ),
)
def missing_fields(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumns(
        {
            "tool_id": F.when(F.col("severity") != "INFO", F.col("tool_id")),
            "raw_message": F.when(F.col("log_type") == "alarm", F.lit("")).otherwise(F.col("raw_message")),
        }
    )
    names = N.missing_fields(S.MANDATORY_LOG_FIELDS)
    return rows.select("id", F.array_join(names, " ").alias("missing"))


@query(
    "unmapped_columns",
    with_logs(
        """SELECT DISTINCT source_filename, c AS "column" FROM (
             SELECT source_filename, unnest(['alarm_code', 'k_' || log_type]) AS c FROM logs)"""
    ),
)
def unmapped_columns(spark, sf_dir):
    rows = logs(spark, sf_dir)
    entries = F.array(
        E.text_entry(F.lit("tool_id"), F.col("tool_id")),
        E.text_entry(F.lit("alarm_code"), F.col("alarm_code")),
        E.text_entry(F.concat(F.lit("k_"), F.col("log_type")), F.lit("x")),
    )
    return A.unmapped_columns(N.normalise_entries(_records(rows, entries), INGEST_TS))


@query(
    "template_remap",
    with_logs("SELECT id, tool_id, event_name, severity, 'kept' AS other, 'x=' || tool_id AS raw FROM logs"),
)
def template_remap(spark, sf_dir):
    """Fields renamed by a saved mapping; the others are kept, under their own names too."""
    rows = logs(spark, sf_dir)
    entries = F.array(
        E.text_entry(F.lit("x"), F.col("tool_id")),
        E.text_entry(F.lit("what"), F.col("event_name")),
        E.text_entry(F.lit("sev"), F.col("severity")),
        E.text_entry(F.lit("other"), F.lit("kept")),
    )
    mapping = F.create_map(*[F.lit(v) for v in ("x", "tool_id", "what", "event_name", "gone", "unit")])
    renamed = remap(entries, mapping)
    found = N.normalise_entries(_records(rows, renamed), INGEST_TS)
    return found.select(
        "id", "tool_id", "event_name", "severity",
        F.get_json_object("metadata", "$.other").alias("other"),
        F.concat(F.lit("x="), F.get_json_object("metadata", "$.x")).alias("raw"),
    )


# -- header mappings ------------------------------------------------------------------------------------


def _odd_headers(spark, sf_dir):
    """Two layouts with unusual names, one of them in two column orders."""
    rows = spread(logs(spark, sf_dir))
    cells = [
        E.text_entry(F.lit("ts_utc"), F.col("timestamp")),
        E.text_entry(F.lit("equip_no"), F.col("tool_id")),
        E.text_entry(F.lit("lvl"), F.col("severity")),
        E.text_entry(F.lit("lot_no"), F.col("wafer_id")),
        E.text_entry(F.lit("lot_copy"), F.col("wafer_id")),
        E.text_entry(F.lit("body"), F.concat("event_name", F.lit(" seen"))),
        E.text_entry(F.lit("note"), F.lit("~")),
    ]
    wide = F.array(*cells)
    turned = F.array(*reversed(cells))
    narrow = F.array(E.text_entry(F.lit("tool"), F.col("tool_id")), E.text_entry(F.lit("message"), F.col("event_name")))
    kind = F.col("log_type")
    entries = F.when(kind == "info", narrow).when(kind == "alarm", turned).otherwise(wide)
    records = rows.select(
        "id", "source_filename", F.lit("csv").alias("source_format"), F.lit(0).cast("bigint").alias("block"),
        F.col("id").cast("bigint").alias("row"), entries.alias("entries"),
    )
    return H.with_fingerprint(records)


@query(
    "inferred_header_mappings",
    with_logs(
        """SELECT sha256('body|equip_no|lot_copy|lot_no|lvl|note|ts_utc') AS header_fingerprint, unnest(['ts_utc', 'equip_no', 'lvl', 'body', lot]) AS "column",
             unnest(['timestamp', 'tool_id', 'severity', 'event_name', 'wafer_id']) AS canonical
           FROM (SELECT CASE WHEN log_type = 'alarm' THEN 'lot_copy' ELSE 'lot_no' END AS lot FROM logs WHERE log_type <> 'info'
                 ORDER BY source_filename, CAST(id AS BIGINT) LIMIT 1)"""
    ),
)
def inferred_header_mappings(spark, sf_dir):
    """One mapping per distinct header, from what the sampled values look like; of two equal columns the
    first in the first record takes the wafer field."""
    found = H.infer_header_mappings(_odd_headers(spark, sf_dir))
    return found.select("header_fingerprint", F.explode("mapping").alias("column", "canonical"))


@query(
    "records_with_header_mapping",
    with_logs(
        """SELECT id, CASE WHEN log_type = 'info' THEN '2024-06-01T00:00:00' ELSE timestamp END AS timestamp, tool_id,
             CASE WHEN log_type = 'info' THEN 'INFO' ELSE severity END AS severity,
             event_name || CASE WHEN log_type = 'info' THEN '' ELSE ' seen' END AS event_name,
             CASE WHEN log_type <> 'info' THEN wafer_id END AS wafer_id FROM logs"""
    ),
)
def records_with_header_mapping(spark, sf_dir):
    """Mappings inferred, looked up by fingerprint and applied."""
    records = stored(_odd_headers(spark, sf_dir), "odd")
    mappings = H.infer_header_mappings(records)
    found = N.normalise_entries(match_headers(records, mappings), INGEST_TS, mapping="mapping")
    return found.select("id", "timestamp", "tool_id", "severity", "event_name", "wafer_id")


@query(
    "valid_mapping_claims",
    """SELECT event_type, column_name, canonical FROM (
         SELECT event_type, 'c' || event_id AS column_name, canonical, row_number() OVER (PARTITION BY event_type, canonical ORDER BY event_id) AS n
         FROM (SELECT event_type, event_id, (['timestamp', 'tool_id', 'nonsense', 'unit'])[event_id % 4 + 1] AS canonical FROM events)
         WHERE canonical <> 'nonsense') WHERE n = 1""",
)
def valid_mapping_claims(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    claims = e.select(
        F.col("event_type").alias("fingerprint"),
        F.col("event_id").alias("position"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("column"),
        _pick(["timestamp", "tool_id", "nonsense", "unit"], F.col("event_id")).alias("canonical"),
    )
    return H.valid_claims(claims).select(
        F.col("fingerprint").alias("event_type"), F.col("column").alias("column_name"), "canonical"
    )


@query(
    "clean_prompt_text",
    """SELECT conv_id, turn, left(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g'), 1500) AS text FROM conversations""",
)
def clean_prompt_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", X.sanitize(F.col("text")).alias("text"))

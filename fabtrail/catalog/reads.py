"""Filters, ordered reads, views, aggregates and sequences over the event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabtrail import schema as S
from fabtrail.catalog.base import LOGS_SQL, logs_from_events as logs, query, table, with_logs
from fabtrail.functions.rules import severity_rank
from fabtrail.functions.text import display_time, hour_of
from fabtrail.operators import aggregates as A, filters as Q, sequences as W
from fabtrail.operators.tables import to_recipes

ROW = ["id", "timestamp", "tool_id", "severity", "log_type", "event_name", "source_filename"]
ROW_SQL = ", ".join(ROW)

# -- filters ------------------------------------------------------------------------------------


@query("filter_tool", with_logs(f"SELECT {ROW_SQL} FROM logs WHERE tool_id = 'TOOL-0008'"))
def filter_tool(spark, sf_dir):
    return Q.filter_logs(logs(spark, sf_dir), tool_id="TOOL-0008").select(*ROW)


@query("filter_severity", with_logs(f"SELECT {ROW_SQL} FROM logs WHERE severity = 'ERROR'"))
def filter_severity(spark, sf_dir):
    return Q.filter_logs(logs(spark, sf_dir), severity="ERROR").select(*ROW)


@query("filter_log_type", with_logs(f"SELECT {ROW_SQL} FROM logs WHERE log_type = 'maintenance'"))
def filter_log_type(spark, sf_dir):
    return Q.filter_logs(logs(spark, sf_dir), log_type="maintenance").select(*ROW)


@query("filter_start", with_logs(f"SELECT {ROW_SQL} FROM logs WHERE timestamp >= '2024-01-15T12:00:00'"))
def filter_start(spark, sf_dir):
    return Q.filter_logs(logs(spark, sf_dir), start_ts="2024-01-15T12:00:00").select(*ROW)


@query("filter_end", with_logs(f"SELECT {ROW_SQL} FROM logs WHERE timestamp <= '2024-01-15T12:00:00'"))
def filter_end(spark, sf_dir):
    return Q.filter_logs(logs(spark, sf_dir), end_ts="2024-01-15T12:00:00").select(*ROW)


@query("filter_file", with_logs(f"SELECT {ROW_SQL} FROM logs WHERE source_filename = 'events_20240105.log'"))
def filter_file(spark, sf_dir):
    return Q.filter_logs(logs(spark, sf_dir), source_filename="events_20240105.log").select(*ROW)


@query("filter_format", with_logs(f"SELECT {ROW_SQL} FROM logs WHERE source_format = 'csv'"))
def filter_format(spark, sf_dir):
    return Q.filter_logs(logs(spark, sf_dir), source_format="csv").select(*ROW)


@query("search_text", with_logs(f"SELECT {ROW_SQL} FROM logs WHERE raw_message ILIKE '%pump%' OR event_name ILIKE '%pump%'"))
def search_text(spark, sf_dir):
    return Q.filter_logs(logs(spark, sf_dir), search_term="pump").select(*ROW)


@query("search_wildcard", with_logs(f"SELECT {ROW_SQL} FROM logs WHERE raw_message ILIKE '%USER%user 1_%' OR event_name ILIKE '%USER%user 1_%'"))
def search_wildcard(spark, sf_dir):
    return Q.filter_logs(logs(spark, sf_dir), search_term="USER%user 1_").select(*ROW)


@query(
    "filter_all_predicates",
    with_logs(
        f"""SELECT {ROW_SQL} FROM logs
        WHERE severity = 'ERROR' AND log_type = 'alarm' AND timestamp >= '2024-01-03'
          AND timestamp <= '2024-01-20T00:00:00' AND (raw_message ILIKE '%fault%' OR event_name ILIKE '%fault%')"""
    ),
)
def filter_all_predicates(spark, sf_dir):
    return Q.filter_logs(
        logs(spark, sf_dir),
        tool_id="",
        severity="ERROR",
        log_type="alarm",
        start_ts="2024-01-03",
        end_ts="2024-01-20T00:00:00",
        search_term="fault",
        source_filename=None,
    ).select(*ROW)


@query("filter_none", with_logs(f"SELECT {ROW_SQL} FROM logs"))
def filter_none(spark, sf_dir):
    return Q.filter_logs(logs(spark, sf_dir)).select(*ROW)


@query("faults", with_logs(f"SELECT {ROW_SQL} FROM logs WHERE severity IN ('ERROR', 'CRITICAL')"))
def faults(spark, sf_dir):
    return Q.faults(logs(spark, sf_dir)).select(*ROW)


@query(
    "metadata_field_present",
    with_logs("SELECT id, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k FROM logs WHERE json_extract(metadata, '$.k') IS NOT NULL"),
)
def metadata_field_present(spark, sf_dir):
    rows = logs(spark, sf_dir).where(Q.has_metadata("k"))
    return rows.select("id", Q.metadata_value("k", "bigint").alias("k"))


@query(
    "drop_incomplete",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN value < 150 THEN value END AS parameter_value
       FROM events WHERE value < 150""",
)
def drop_incomplete(spark, sf_dir):
    df = logs(spark, sf_dir).withColumn(
        "parameter_value", F.when(F.col("parameter_value") < 150, F.col("parameter_value"))
    )
    return Q.drop_incomplete(df, "event_ts", "parameter_value").select("id", "parameter_value")


@query(
    "adhoc_sql",
    with_logs(
        f"""SELECT {ROW_SQL} FROM logs WHERE source_filename LIKE 'events_202401%'
        ORDER BY timestamp DESC, id DESC LIMIT 50"""
    ),
)
def adhoc_sql(spark, sf_dir):
    return spark.sql(
        f"""SELECT {ROW_SQL} FROM {{logs}} WHERE source_filename LIKE 'events_202401%'
        ORDER BY timestamp DESC, id DESC LIMIT 50""",
        logs=logs(spark, sf_dir),
    )


_RECIPES_SQL = LOGS_SQL + """, recipes AS (
  SELECT id, timestamp, tool_id, recipe_id, source_filename FROM logs WHERE log_type = 'process_step')
"""


def _recipes(spark, sf_dir):
    """Recipe table: the process rows taken as recipe rows."""
    rows = logs(spark, sf_dir).where(F.col("log_type") == "process_step")
    return to_recipes(rows.withColumn("log_type", F.lit("recipe")))


@query(
    "recipes_by_id",
    _RECIPES_SQL + "SELECT * FROM recipes WHERE recipe_id = 'RCP_purchase_v3' ORDER BY timestamp DESC, id DESC LIMIT 500",
)
def recipes_by_id(spark, sf_dir):
    return Q.query_recipes(_recipes(spark, sf_dir), recipe_id="RCP_purchase_v3").select(
        "id", "timestamp", "tool_id", "recipe_id", "source_filename"
    )


@query(
    "recipes_by_tool_and_file",
    _RECIPES_SQL + """SELECT * FROM recipes
      WHERE tool_id = (SELECT min(tool_id) FROM recipes WHERE source_filename = 'events_20240105.log') AND source_filename = 'events_20240105.log'
      ORDER BY timestamp DESC, id DESC LIMIT 500""",
)
def recipes_by_tool_and_file(spark, sf_dir):
    """The rows of one tool, the first by name that the file has."""
    recipes, name = _recipes(spark, sf_dir), "events_20240105.log"
    tool = recipes.where(F.col("source_filename") == name).agg(F.min("tool_id")).first()[0]
    rows = Q.query_recipes(recipes, tool_id=tool, source_filename=name)
    return rows.select("id", "timestamp", "tool_id", "recipe_id", "source_filename")


_LIVE_SQL = LOGS_SQL + """, live AS (
  SELECT CASE WHEN log_type = 'info' THEN 'mqtt_' || tool_id || '.json' ELSE source_filename END AS source_name, *
  FROM logs)
SELECT timestamp, tool_id, severity, event_name, parameter_name, parameter_value, unit, wafer_id, recipe_id
FROM live WHERE starts_with(source_name, 'mqtt_') ORDER BY timestamp DESC, id DESC LIMIT 100
"""


@query("live_view", _LIVE_SQL)
def live_view(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumn(
        "source_filename",
        F.when(
            F.col("log_type") == "info", F.concat(F.lit("mqtt_"), F.col("tool_id"), F.lit(".json"))
        ).otherwise(F.col("source_filename")),
    )
    return Q.live_view(rows)


# -- ordered reads and views ----------------------------------------------------------------------


@query("latest_logs", with_logs(f"SELECT {ROW_SQL} FROM logs ORDER BY timestamp DESC, id DESC LIMIT 1000"))
def latest_logs(spark, sf_dir):
    return Q.query_logs(logs(spark, sf_dir)).select(*ROW)


@query("latest_recipes", _RECIPES_SQL + "SELECT * FROM recipes ORDER BY timestamp DESC, id DESC LIMIT 500")
def latest_recipes(spark, sf_dir):
    return Q.query_recipes(_recipes(spark, sf_dir)).select(
        "id", "timestamp", "tool_id", "recipe_id", "source_filename"
    )


@query(
    "latest_errors_export",
    with_logs(f"SELECT {ROW_SQL} FROM logs WHERE severity = 'ERROR' ORDER BY timestamp DESC, id DESC LIMIT 50000"),
)
def latest_errors_export(spark, sf_dir):
    return Q.query_logs(
        logs(spark, sf_dir), limit=S.DEFAULT_LIMITS["export"], severity="ERROR"
    ).select(*ROW)


@query(
    "severity_rank",
    with_logs(
        """SELECT id, severity, CASE severity WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARNING' THEN 2
             WHEN 'ERROR' THEN 3 ELSE 4 END AS severity_rank FROM logs"""
    ),
)
def rank_of_severity(spark, sf_dir):
    return Q.by_severity(logs(spark, sf_dir)).select("id", "severity", "severity_rank")


@query(
    "display_view",
    with_logs(
        """SELECT timestamp, tool_id, severity, log_type, event_name, parameter_name, parameter_value, unit,
             wafer_id, recipe_id, source_format FROM logs"""
    ),
)
def display_view(spark, sf_dir):
    rows = logs(spark, sf_dir).drop("step_number", "drain_cluster_id", "normalized_message")
    return Q.display_view(rows)


@query(
    "summary_view",
    with_logs(
        """SELECT left(timestamp, 19) AS timestamp, tool_id, severity,
             left(coalesce(event_name, raw_message), 50) AS event, parameter_name,
             CASE WHEN parameter_value <> 0 THEN parameter_value END AS parameter_value, unit, wafer_id FROM logs"""
    ),
)
def summary_view(spark, sf_dir):
    return Q.summary_view(logs(spark, sf_dir))


@query(
    "clip_long_text",
    """SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END AS raw_message FROM documents""",
)
def clip_long_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumnRenamed("text", "raw_message")
    return Q.clipped(rows, 120).select("doc_id", "raw_message")


@query(
    "fault_display",
    with_logs(
        """SELECT id, '[' || timestamp || '] ' || tool_id || ' — ' || event_name AS display
           FROM logs WHERE severity IN ('ERROR', 'CRITICAL')"""
    ),
)
def fault_display(spark, sf_dir):
    listed = W.fault_list(logs(spark, sf_dir))
    return listed.select(
        "id", display_time(F.col("timestamp"), F.col("tool_id"), F.col("event_name")).alias("display")
    )


@query(
    "flatten_metadata",
    with_logs("SELECT id, tool_id, json_extract_string(metadata, '$.k') AS k FROM logs"),
)
def flatten_metadata(spark, sf_dir):
    return Q.flatten_metadata(logs(spark, sf_dir), ["k", "tool_id"]).select("id", "tool_id", "k")


# -- aggregates -----------------------------------------------------------------------------------

_FIGURES_SQL = """count(*) AS total, count(*) FILTER (log_type = 'alarm') AS alarms,
  count(*) FILTER (severity IN ('ERROR', 'CRITICAL')) AS errors,
  count(*) FILTER (severity = 'WARNING') AS warnings, count(DISTINCT tool_id) AS tools"""


@query("summary_stats", _RECIPES_SQL + f"SELECT {_FIGURES_SQL}, (SELECT count(*) FROM recipes) AS recipes FROM logs")
def summary_stats(spark, sf_dir):
    return A.summary_stats(logs(spark, sf_dir), _recipes(spark, sf_dir))


@query(
    "summary_stats_of_file",
    _RECIPES_SQL + f"""SELECT {_FIGURES_SQL}, (SELECT count(*) FROM recipes WHERE source_filename = 'events_20240105.log') AS recipes
      FROM logs WHERE source_filename = 'events_20240105.log'""",
)
def summary_stats_of_file(spark, sf_dir):
    return A.summary_stats(logs(spark, sf_dir), _recipes(spark, sf_dir), "events_20240105.log")


@query("stats_by_file", with_logs(f"SELECT source_filename, {_FIGURES_SQL} FROM logs GROUP BY source_filename"))
def stats_by_file(spark, sf_dir):
    return A.stats_by_file(logs(spark, sf_dir))


@query("distinct_tools", with_logs("SELECT DISTINCT tool_id AS value FROM logs WHERE tool_id <> ''"))
def distinct_tools(spark, sf_dir):
    return A.distinct_values(logs(spark, sf_dir), "tool_id")


@query(
    "distinct_metadata_values",
    with_logs("SELECT DISTINCT json_extract_string(metadata, '$.k') AS value FROM logs WHERE json_extract_string(metadata, '$.k') <> ''"),
)
def distinct_metadata_values(spark, sf_dir):
    return A.distinct_values(logs(spark, sf_dir), "k")


@query("distinct_parameter_values", with_logs("SELECT DISTINCT parameter_value AS value FROM logs WHERE parameter_value <> 0"))
def distinct_parameter_values(spark, sf_dir):
    return A.distinct_values(logs(spark, sf_dir), "parameter_value")


@query(
    "value_lists",
    with_logs(
        """SELECT DISTINCT * FROM (
             SELECT 'tool_id' AS "column", tool_id AS value FROM logs UNION ALL SELECT 'severity', severity FROM logs
             UNION ALL SELECT 'source_format', source_format FROM logs
             UNION ALL SELECT 'source_filename', source_filename FROM logs)"""
    ),
)
def value_lists(spark, sf_dir):
    return A.value_lists(
        logs(spark, sf_dir), ["tool_id", "severity", "source_format", "source_filename"]
    )


for _column in ("severity", "log_type"):

    @query(f"{_column}_distribution", with_logs(f'SELECT {_column}, count(*) AS "count" FROM logs GROUP BY {_column}'))
    def distribution(spark, sf_dir, column=_column):
        return A.value_counts(logs(spark, sf_dir), column)


@query(
    "hourly_volume",
    with_logs("""SELECT date_trunc('hour', event_ts) AS hour, severity, count(*) AS "count" FROM logs GROUP BY 1, 2"""),
)
def hourly_volume(spark, sf_dir):
    return A.hourly_volume(logs(spark, sf_dir))


@query("alarms_per_tool", with_logs("""SELECT tool_id, count(*) AS "count" FROM logs WHERE log_type = 'alarm' GROUP BY 1"""))
def alarms_per_tool(spark, sf_dir):
    return A.alarms_per_tool(logs(spark, sf_dir))


@query(
    "top_anomalies",
    with_logs(
        """SELECT coalesce(event_name, raw_message) AS event_name, count(*) AS freq FROM (
             SELECT CASE WHEN severity = 'ERROR' THEN NULL ELSE event_name END AS event_name, raw_message, severity FROM logs)
           WHERE severity IN ('ERROR', 'CRITICAL') GROUP BY 1 ORDER BY freq DESC, event_name LIMIT 5"""
    ),
)
def top_anomalies(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumn(
        "event_name", F.when(F.col("severity") != "ERROR", F.col("event_name"))
    )
    return A.top_anomalies(rows)


@query(
    "top_anomalies_by_file",
    with_logs(
        """SELECT source_filename, event_name, freq, rank FROM (
             SELECT source_filename, raw_message AS event_name, count(*) AS freq,
               CAST(row_number() OVER (PARTITION BY source_filename ORDER BY count(*) DESC, raw_message) AS INTEGER) AS rank
             FROM logs WHERE severity IN ('ERROR', 'CRITICAL') GROUP BY 1, 2) WHERE rank <= 5"""
    ),
)
def top_anomalies_by_file(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumn("event_name", F.col("raw_message"))
    return A.top_anomalies_by_file(rows)


@query(
    "ingest_report",
    with_logs(
        """SELECT source_filename, count(*) AS records, min(source_format) AS source_format, count(DISTINCT tool_id) AS tools,
             count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'ERROR') AS error,
             count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info,
             count(*) FILTER (severity = 'DEBUG') AS debug FROM logs GROUP BY 1"""
    ),
)
def ingest_report(spark, sf_dir):
    return A.ingest_report(logs(spark, sf_dir))


@query(
    "shift_report",
    with_logs(
        """SELECT 'figure' AS section, 'total' AS item, count(*) AS value FROM logs
           UNION ALL SELECT 'figure', 'errors', count(*) FROM logs WHERE severity IN ('ERROR', 'CRITICAL')
           UNION ALL SELECT 'figure', 'alarms', count(*) FROM logs WHERE log_type = 'alarm'
           UNION ALL SELECT 'tool', tool_id, count(*) FROM logs GROUP BY tool_id
           UNION ALL SELECT 'anomaly', event_name, freq FROM (
             SELECT event_name, count(*) AS freq FROM logs WHERE severity IN ('ERROR', 'CRITICAL')
             GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"""
    ),
)
def shift_report(spark, sf_dir):
    return A.shift_report(logs(spark, sf_dir))


@query(
    "extraction_coverage",
    with_logs(
        """SELECT source_filename, source_format, count(*) AS records,
             avg(CASE WHEN timestamp <> '' AND tool_id <> '' AND severity <> '' AND message <> '' THEN 1.0 ELSE 0.0 END) AS coverage
           FROM (SELECT *, CASE WHEN parameter_value < 20 THEN '' ELSE raw_message END AS message FROM logs) GROUP BY 1, 2"""
    ),
)
def extraction_coverage(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumn(
        "raw_message", F.when(F.col("parameter_value") < 20, F.lit("")).otherwise(F.col("raw_message"))
    )
    return A.extraction_coverage(rows)


@query(
    "session_context",
    with_logs(
        f"""SELECT {_FIGURES_SQL}, 0::BIGINT AS recipes,
              (SELECT string_agg(concat_ws('|', timestamp, id, tool_id, severity, log_type, event_name, raw_message), ';' ORDER BY timestamp DESC, id DESC)
               FROM (SELECT * FROM logs ORDER BY timestamp DESC, id DESC LIMIT 30)) AS sample FROM logs"""
    ),
)
def session_context(spark, sf_dir):
    found = A.session_context(logs(spark, sf_dir))
    names = ["timestamp", "id", "tool_id", "severity", "log_type", "event_name", "raw_message"]
    rows = F.from_json("sample", "array<struct<" + ", ".join(f"{n}: string" for n in names) + ">>")
    return found.withColumn("sample", F.array_join(F.transform(rows, lambda r: F.concat_ws("|", *[r[n] for n in names])), ";"))


@query(
    "first_warnings",
    with_logs(
        """SELECT source_filename, id AS warning, CAST(rank AS INTEGER) AS rank FROM (
             SELECT source_filename, id, row_number() OVER (PARTITION BY source_filename ORDER BY CAST(id AS BIGINT)) AS rank
             FROM logs WHERE severity = 'WARNING') WHERE rank <= 5"""
    ),
)
def first_warnings(spark, sf_dir):
    rows = logs(spark, sf_dir).where(F.col("severity") == "WARNING")
    notes = rows.select(
        "source_filename",
        F.lit(0).alias("block"),
        F.col("id").cast("bigint").alias("row"),
        F.col("id").alias("warning"),
    )
    return A.first_warnings(notes).select("source_filename", "warning", "rank")


# -- larger tables ----------------------------------------------------------------------------------

_ORDER_LOGS_SQL = """
WITH logs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS timestamp,
    'TOOL-' || CAST(o_custkey AS VARCHAR) AS tool_id, o_orderdate AS event_ts, o_totalprice AS parameter_value,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'ERROR' WHEN '3-MEDIUM' THEN 'WARNING'
      WHEN '4-NOT SPECIFIED' THEN 'INFO' ELSE 'DEBUG' END AS severity,
    CASE o_orderstatus WHEN 'F' THEN 'alarm' ELSE 'info' END AS log_type FROM orders)
"""


def _order_logs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    levels = dict(zip(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], ["CRITICAL", "ERROR", "WARNING", "INFO"]))
    severity = F.when(F.lit(False), F.lit(""))
    for name, level in levels.items():
        severity = severity.when(F.col("o_orderpriority") == name, F.lit(level))
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("TOOL-"), F.col("o_custkey").cast("string")).alias("tool_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("event_ts"),
        F.col("o_totalprice").alias("parameter_value"),
        severity.otherwise(F.lit("DEBUG")).alias("severity"),
        F.when(F.col("o_orderstatus") == "F", F.lit("alarm")).otherwise(F.lit("info")).alias("log_type"),
    )


@query("order_log_stats", _ORDER_LOGS_SQL + f"SELECT {_FIGURES_SQL}, 0::BIGINT AS recipes FROM logs")
def order_log_stats(spark, sf_dir):
    return A.summary_stats(_order_logs(spark, sf_dir))


@query("order_log_volume", _ORDER_LOGS_SQL + """SELECT date_trunc('hour', event_ts) AS hour, severity, count(*) AS "count" FROM logs GROUP BY 1, 2""")
def order_log_volume(spark, sf_dir):
    return A.hourly_volume(_order_logs(spark, sf_dir))


@query("order_log_latest", _ORDER_LOGS_SQL + "SELECT id, timestamp, tool_id, severity FROM logs WHERE severity = 'CRITICAL' ORDER BY timestamp DESC, id DESC LIMIT 1000")
def order_log_latest(spark, sf_dir):
    rows = Q.filter_logs(_order_logs(spark, sf_dir), severity="CRITICAL")
    return Q.latest(rows, 1000).select("id", "timestamp", "tool_id", "severity")


@query(
    "shipment_volume",
    """SELECT 'TOOL-' || CAST(l_suppkey AS VARCHAR) AS tool_id,
         CASE l_returnflag WHEN 'R' THEN 'ERROR' WHEN 'A' THEN 'WARNING' ELSE 'INFO' END AS severity,
         count(*) AS "count" FROM lineitem GROUP BY 1, 2""",
)
def shipment_volume(spark, sf_dir):
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("TOOL-"), F.col("l_suppkey").cast("string")).alias("tool_id"),
        F.when(flag == "R", F.lit("ERROR")).when(flag == "A", F.lit("WARNING")).otherwise(F.lit("INFO")).alias("severity"),
    )
    return A.value_counts(rows, "tool_id", "severity")


# -- sequences ------------------------------------------------------------------------------------


@query(
    "fault_list",
    with_logs("SELECT id, timestamp, tool_id, coalesce(event_name, raw_message) AS event_name FROM logs WHERE severity IN ('ERROR', 'CRITICAL')"),
)
def fault_list(spark, sf_dir):
    return W.fault_list(logs(spark, sf_dir)).drop("drain_cluster_id")


_SEQUENCE_SQL = LOGS_SQL + """
SELECT f.id AS fault_id, f.source_filename, f.tool_id, f.timestamp AS fault_timestamp, r.steps_back, r.id, r.timestamp,
  r.severity, r.log_type, r.parameter_name, r.parameter_value, r.unit, r.event_name, r.raw_message,
  r.timestamp = f.timestamp AS is_target
FROM logs f, LATERAL (
  SELECT *, row_number() OVER (ORDER BY timestamp DESC, id DESC) AS steps_back FROM logs r
  WHERE r.source_filename = f.source_filename AND r.tool_id = f.tool_id AND r.timestamp <= f.timestamp
  ORDER BY timestamp DESC, id DESC LIMIT 20) r
WHERE f.severity IN ('ERROR', 'CRITICAL')
"""


@query("preceding_events", _SEQUENCE_SQL)
def preceding_events(spark, sf_dir):
    return W.preceding_events(logs(spark, sf_dir)).drop("drain_cluster_id")


@query(
    "preceding_events_one_busy_tool",
    _SEQUENCE_SQL.replace("SELECT f.id AS fault_id", "SELECT f.id AS fault_id").replace(
        "FROM logs f, LATERAL", "FROM (SELECT * REPLACE (CASE WHEN log_type IN ('alarm', 'info') THEN 'TOOL-BUSY' ELSE tool_id END AS tool_id, left(timestamp, 13) AS timestamp) FROM logs) f, LATERAL"
    ).replace(
        "FROM logs r\n", "FROM (SELECT * REPLACE (CASE WHEN log_type IN ('alarm', 'info') THEN 'TOOL-BUSY' ELSE tool_id END AS tool_id, left(timestamp, 13) AS timestamp) FROM logs) r\n"
    ),
)
def preceding_events_one_busy_tool(spark, sf_dir):
    """One tool with a large share of the rows and many rows at the same time."""
    rows = logs(spark, sf_dir).withColumns(
        {
            "tool_id": F.when(F.col("log_type").isin("alarm", "info"), F.lit("TOOL-BUSY")).otherwise(
                F.col("tool_id")
            ),
            "timestamp": F.left("timestamp", F.lit(13)),
        }
    )
    return W.preceding_events(rows).drop("drain_cluster_id")


@query(
    "sequence_of_newest_fault",
    with_logs(
        """, fault AS (SELECT * FROM logs WHERE severity = 'CRITICAL' ORDER BY timestamp DESC, id DESC LIMIT 1)
        SELECT r.id, r.timestamp, r.severity, r.timestamp = f.timestamp AS is_target FROM logs r, fault f
        WHERE r.tool_id = f.tool_id AND r.source_filename = f.source_filename AND r.timestamp <= f.timestamp
        ORDER BY r.timestamp DESC, r.id DESC LIMIT 20"""
    ),
)
def sequence_of_newest_fault(spark, sf_dir):
    rows = logs(spark, sf_dir)
    newest = Q.latest(rows.where(F.col("severity") == "CRITICAL"), 1).first()
    return W.sequence_of(rows, newest["id"]).select("id", "timestamp", "severity", "is_target")


@query(
    "drop_empty_columns",
    with_logs("SELECT * EXCLUDE (alarm_code, wafer_id, recipe_id, source_format, metadata) FROM logs"),
)
def drop_empty_columns(spark, sf_dir):
    rows = logs(spark, sf_dir).drop("alarm_code", "wafer_id", "recipe_id", "source_format", "metadata")
    return W.drop_empty_columns(rows)


@query(
    "sensor_series",
    with_logs("SELECT tool_id, parameter_name, event_ts, parameter_value, unit, id FROM logs WHERE parameter_name = 'pressure'"),
)
def sensor_series(spark, sf_dir):
    return W.sensor_series(logs(spark, sf_dir), "pressure")


@query(
    "cumulative_series",
    with_logs(
        """SELECT tool_id, parameter_name, event_ts, parameter_value, unit, id,
             count(*) OVER (PARTITION BY tool_id, parameter_name ORDER BY event_ts) AS points
           FROM (SELECT * REPLACE (date_trunc('hour', event_ts) AS event_ts,
             CASE WHEN log_type = 'info' THEN NULL ELSE parameter_name END AS parameter_name) FROM logs)"""
    ),
)
def cumulative_series(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumns(
        {
            "event_ts": hour_of(F.col("event_ts")),
            "parameter_name": F.when(F.col("log_type") != "info", F.col("parameter_name")),
        }
    )
    return W.cumulative_series(rows)


@query("latest_entry", with_logs(f"SELECT {ROW_SQL} FROM logs ORDER BY timestamp DESC, id DESC LIMIT 1"))
def latest_entry(spark, sf_dir):
    return W.latest_entry(logs(spark, sf_dir).select(*ROW))


@query(
    "latest_entry_per_tool",
    with_logs(f"SELECT {ROW_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY tool_id ORDER BY timestamp DESC, id DESC) AS n FROM logs) WHERE n = 1"),
)
def latest_entry_per_tool(spark, sf_dir):
    return W.latest_entry(logs(spark, sf_dir).select(*ROW), "tool_id")

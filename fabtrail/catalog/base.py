"""The catalogue of registered queries: a Spark callable and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fabtrail import schema as S

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- event rows as equipment logs ---------------------------------------------------------------

LOGS_SQL = """
WITH logs AS (
  SELECT
    CAST(event_id AS VARCHAR) AS id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
    'TOOL-' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS tool_id,
    CASE event_type WHEN 'error' THEN 'alarm' WHEN 'view' THEN 'sensor_reading'
      WHEN 'purchase' THEN 'process_step' WHEN 'signup' THEN 'maintenance' ELSE 'info' END AS log_type,
    CASE WHEN event_type = 'error' AND value >= 100 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR'
      WHEN event_type = 'signup' THEN 'WARNING' ELSE 'INFO' END AS severity,
    CASE WHEN event_type = 'error' THEN 'Pump fault' ELSE 'User ' || event_type END
      || ' at user ' || CAST(user_id AS VARCHAR) AS raw_message,
    props AS metadata,
    CASE event_type WHEN 'error' THEN 'text' WHEN 'view' THEN 'csv' WHEN 'purchase' THEN 'xml'
      WHEN 'signup' THEN 'kv' ELSE 'json' END AS source_format,
    'events_' || strftime(ts, '%Y%m%d') || '.log' AS source_filename,
    CASE WHEN event_type = 'error' THEN 'Pump fault' ELSE 'User ' || event_type END AS event_name,
    'RCP_' || event_type || '_v' || CAST(user_id % 5 AS VARCHAR) AS recipe_id,
    'LOT' || lpad(CAST(user_id AS VARCHAR), 4, '0') || '-W' || lpad(CAST(event_id % 25 AS VARCHAR), 2, '0') AS wafer_id,
    'pressure' AS parameter_name,
    value AS parameter_value,
    'mTorr' AS unit,
    CASE WHEN event_type IN ('error', 'signup')
      THEN 'E' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END AS alarm_code,
    date_trunc('second', ts) AS event_ts
  FROM events
)
"""


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical log rows from the events table; every event is one row."""
    e = table(spark, sf_dir, "events")
    kind, user, number = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id")

    def by_kind(default: str, **names: str):
        col = F.when(kind == "error", F.lit(names["error"]))
        for key in ("view", "purchase", "signup"):
            col = col.when(kind == key, F.lit(names[key]))
        return col.otherwise(F.lit(default))

    event = F.when(kind == "error", F.lit("Pump fault")).otherwise(F.concat(F.lit("User "), kind))
    severity = (
        F.when((kind == "error") & (F.col("value") >= 100), F.lit("CRITICAL"))
        .when(kind == "error", F.lit("ERROR"))
        .when(kind == "signup", F.lit("WARNING"))
        .otherwise(F.lit("INFO"))
    )
    none = F.lit(None)
    padded = lambda c, n: F.lpad(c.cast("string"), n, "0")
    cols = {
        "id": number.cast("string"),
        "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        "tool_id": F.concat(F.lit("TOOL-"), padded(F.col("user_id"), 4)),
        "log_type": by_kind(
            "info", error="alarm", view="sensor_reading", purchase="process_step", signup="maintenance"
        ),
        "severity": severity,
        "raw_message": F.concat(event, F.lit(" at user "), user),
        "metadata": F.col("props"),
        "source_format": by_kind("json", error="text", view="csv", purchase="xml", signup="kv"),
        "source_filename": F.concat(F.lit("events_"), F.date_format("ts", "yyyyMMdd"), F.lit(".log")),
        "event_ts": F.date_trunc("second", F.col("ts")).cast("timestamp_ntz"),
        "event_name": event,
        "recipe_id": F.concat(F.lit("RCP_"), kind, F.lit("_v"), (F.col("user_id") % 5).cast("string")),
        "wafer_id": F.concat(
            F.lit("LOT"), padded(F.col("user_id"), 4), F.lit("-W"), padded(number % 25, 2)
        ),
        "parameter_name": F.lit("pressure"),
        "parameter_value": F.col("value"),
        "unit": F.lit("mTorr"),
        "alarm_code": F.when(
            kind.isin("error", "signup"), F.concat(F.lit("E"), padded(number % 1000, 3))
        ),
    }
    return e.select(
        *[cols.get(f.name, none).cast(f.dataType).alias(f.name) for f in S.LOGS]
    )


def with_logs(sql: str) -> str:
    return LOGS_SQL + sql

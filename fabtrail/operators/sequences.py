"""Fault sequences and sensor series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fabtrail.functions.rules import is_fault
from fabtrail.functions.text import ellipsis
from fabtrail.operators.filters import field
from fabtrail.operators.ordering import (
    POSITION,
    SLICE,
    group_values,
    join_group_values,
    number_rows,
)

SEQUENCE_LENGTH = 20
_SHOWN = [
    "timestamp",
    "severity",
    "log_type",
    "parameter_name",
    "parameter_value",
    "unit",
    "event_name",
    "drain_cluster_id",
    "raw_message",
]


def fault_list(df: DataFrame, source_filename: str | None = None) -> DataFrame:
    """Faults, newest first, named by event or else message."""
    if source_filename:
        df = df.where(F.col("source_filename") == source_filename)
    return (
        df.where(is_fault(F.col("severity")))
        .select(
            "id",
            "timestamp",
            "tool_id",
            F.coalesce(field(df, "event_name"), F.col("raw_message")).alias("event_name"),
            "drain_cluster_id",
        )
        .orderBy(F.desc("timestamp"), F.desc("id"))
    )


def preceding_events(df: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """For **every** fault the latest ``length`` rows of its tool and file up to its time.

    Rows are numbered in (file, tool, time, id) order, so the rows before a fault are the
    numbers before its own, and meet it in an equi-join on a number that is unique per row:
    no window over a tool, no range join. Rows at the fault's own time count as before it.
    """
    keys = ["source_filename", "tool_id"]
    text = lambda c: field(df, c)
    slim = df.select(
        *keys,
        "id",
        "timestamp",
        "severity",
        "log_type",
        text("parameter_name").alias("parameter_name"),
        text("parameter_value").cast("double").alias("parameter_value"),
        text("unit").alias("unit"),
        F.coalesce(text("event_name"), F.col("raw_message")).alias("event_name"),
        "drain_cluster_id",
        ellipsis(F.col("raw_message"), 120).alias("raw_message"),
    )
    rows = number_rows(slim, [*keys, "timestamp", "id"])
    at = [*keys, "timestamp"]
    # the last row at a fault's time; its group is met slice by slice
    ends = group_values(rows, at, _last=F.max(POSITION), _faults=F.max(is_fault(F.col("severity"))))
    ends = ends.where("_faults").drop("_faults")
    marked = rows.where(is_fault(F.col("severity"))).select(
        *at, F.col("id").alias("fault_id"), SLICE
    )
    faults = join_group_values(marked, ends, at).select(
        *keys,
        "fault_id",
        F.col("timestamp").alias("fault_timestamp"),
        F.explode(
            F.sequence(F.greatest(F.col("_last") - (length - 1), F.lit(0)), F.col("_last"))
        ).alias(POSITION),
        "_last",
    )
    joined = faults.alias("f").join(
        rows.alias("r"),
        (F.col(f"f.{POSITION}") == F.col(f"r.{POSITION}"))
        & F.col("f.source_filename").eqNullSafe(F.col("r.source_filename"))
        & F.col("f.tool_id").eqNullSafe(F.col("r.tool_id")),
    )
    return joined.select(
        "f.fault_id",
        "f.source_filename",
        "f.tool_id",
        "f.fault_timestamp",
        (F.col("f._last") - F.col(f"f.{POSITION}") + 1).alias("steps_back"),
        F.col("r.id").alias("id"),
        *[F.col(f"r.{c}").alias(c) for c in _SHOWN],
        (F.col("r.timestamp") == F.col("f.fault_timestamp")).alias("is_target"),
    )


def sequence_of(df: DataFrame, fault_id: str, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """The rows before one fault, oldest first."""
    fault = df.where(F.col("id") == fault_id)
    one = lambda c: fault.agg(F.first(c)).scalar()
    before = df.where(
        (F.col("tool_id") == one("tool_id"))
        & (F.col("source_filename") == one("source_filename"))
        & (F.col("timestamp") <= one("timestamp"))
    )
    newest = before.orderBy(F.desc("timestamp"), F.desc("id")).limit(length)
    return newest.withColumn("is_target", F.col("timestamp") == one("timestamp")).orderBy(
        "timestamp", "id"
    )


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row; one aggregate decides."""
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if filled[c] > 0])


def _readings(df: DataFrame) -> DataFrame:
    """Rows with a time and a value, in long form."""
    return df.select(
        "tool_id",
        field(df, "parameter_name").alias("parameter_name"),
        "event_ts",
        field(df, "parameter_value").cast("double").alias("parameter_value"),
        field(df, "unit").alias("unit"),
        "id",
    ).dropna(subset=["event_ts", "parameter_value"])


def sensor_series(df: DataFrame, parameter: str | None = None) -> DataFrame:
    """``(tool_id, parameter_name, event_ts, parameter_value, unit, id)`` rows in time order."""
    rows = _readings(df)
    if parameter:
        rows = rows.where(F.col("parameter_name") == parameter)
    return rows.orderBy("tool_id", "parameter_name", "event_ts", "id")


def cumulative_series(df: DataFrame) -> DataFrame:
    """Series rows with ``points``: how many of the series lie at or before their time.

    A frame of an animation is the filter ``event_ts <= cutoff``; nothing is copied per frame.
    """
    series = ["tool_id", "parameter_name"]
    at = [*series, "event_ts"]
    rows = number_rows(_readings(df), [*at, "id"])
    started = join_group_values(rows, group_values(rows, series, _first=F.min(POSITION)), series)
    both = join_group_values(started, group_values(rows, at, _last=F.max(POSITION)), at)
    return both.withColumn("points", F.col("_last") - F.col("_first") + 1).drop(
        "_first", "_last", POSITION, SLICE
    )


def latest_entry(df: DataFrame, *by: str) -> DataFrame:
    """The newest row, overall or per group; one aggregate without sorting."""
    whole = F.struct(*[c for c in df.columns])
    picked = F.max_by(whole, F.struct("timestamp", "id")).alias("_row")
    rows = df.groupBy(*by).agg(picked) if by else df.agg(picked)
    return rows.select("_row.*")

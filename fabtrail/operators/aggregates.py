"""Counts, distinct values and report figures; every group is pre-aggregated map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fabtrail import schema as S
from fabtrail.functions.rules import is_fault
from fabtrail.functions.text import hour_of
from fabtrail.operators.filters import field

def _figures() -> dict[str, Column]:
    return {
        "total": F.count(F.lit(1)),
        "alarms": F.count_if(F.col("log_type") == "alarm"),
        "errors": F.count_if(is_fault(F.col("severity"))),
        "warnings": F.count_if(F.col("severity") == "WARNING"),
        "tools": F.count_distinct("tool_id"),
    }


def _of_file(df: DataFrame, source_filename: str | None) -> DataFrame:
    return df.where(F.col("source_filename") == source_filename) if source_filename else df


def summary_stats(
    logs: DataFrame, recipes: DataFrame | None = None, source_filename: str | None = None
) -> DataFrame:
    """One row: total, alarms, errors, warnings, tools, recipes; one pass per table."""
    stats = _of_file(logs, source_filename).agg(*[c.alias(n) for n, c in _figures().items()])
    if recipes is None:
        return stats.withColumn("recipes", F.lit(0).cast("bigint"))
    count = _of_file(recipes, source_filename).agg(F.count(F.lit(1))).scalar()
    return stats.withColumn("recipes", count)


def stats_by_file(logs: DataFrame) -> DataFrame:
    """The same figures for every file at once."""
    return logs.groupBy("source_filename").agg(*[c.alias(n) for n, c in _figures().items()])


def distinct_values(df: DataFrame, column: str, source_filename: str | None = None) -> DataFrame:
    """Sorted distinct values of a column or overflow field, without null, '' and 0."""
    value = field(df, column)
    found = _of_file(df, source_filename).select(value.alias("value")).distinct()
    empty = F.lit(0) if dict(found.dtypes)["value"] != "string" else F.lit("")
    return found.where(F.col("value").isNotNull() & (F.col("value") != empty)).orderBy("value")


def value_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value)`` rows: the distinct values of several columns in one pass."""
    pairs = [
        F.struct(F.lit(c).alias("column"), field(df, c).cast("string").alias("value"))
        for c in columns
    ]
    found = df.select(F.inline(F.array(*pairs))).where(F.col("value") != "")
    return found.distinct().orderBy("column", "value")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value, most frequent first, equal counts by value."""
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), *columns)
    )


def hourly_volume(df: DataFrame) -> DataFrame:
    """Rows per hour and severity; rows without a readable time are left out."""
    return (
        df.where(F.col("event_ts").isNotNull())
        .groupBy(hour_of(F.col("event_ts")).alias("hour"), "severity")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def alarms_per_tool(df: DataFrame) -> DataFrame:
    return value_counts(df.where(F.col("log_type") == "alarm"), "tool_id")


def _event(df: DataFrame) -> Column:
    return F.coalesce(field(df, "event_name"), F.col("raw_message"))


def top_anomalies(df: DataFrame, source_filename: str | None = None, k: int = 5) -> DataFrame:
    """The most frequent fault events; equal counts by name."""
    faults = _of_file(df, source_filename).where(is_fault(F.col("severity")))
    return (
        faults.groupBy(_event(df).alias("event_name"))
        .agg(F.count(F.lit(1)).alias("freq"))
        .orderBy(F.desc("freq"), "event_name")
        .limit(k)
    )


def top_anomalies_by_file(df: DataFrame, k: int = 5) -> DataFrame:
    """The same for every file: counts first, then a ranked limit per file."""
    counts = (
        df.where(is_fault(F.col("severity")))
        .groupBy("source_filename", _event(df).alias("event_name"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    order = Window.partitionBy("source_filename").orderBy(F.desc("freq"), "event_name")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ingest_report(df: DataFrame) -> DataFrame:
    """Per file: records, format, tools and rows per severity."""
    return df.groupBy("source_filename").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("source_format").alias("source_format"),
        F.count_distinct("tool_id").alias("tools"),
        *[
            F.count_if(F.col("severity") == s).alias(s.lower())
            for s in S.SEVERITY_REPORT_ORDER
        ],
    )


def review_summary(grid: DataFrame) -> DataFrame:
    """Per job: rows, tools and rows at warning level or above."""
    return grid.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("tool_id").alias("tools"),
        F.count_if(F.col("severity").isin("ERROR", "WARNING", "CRITICAL")).alias("flagged"),
    )


def pending_counts(pending: DataFrame) -> DataFrame:
    return pending.groupBy("job_id").agg(F.count(F.lit(1)).alias("pending"))


def shift_report(df: DataFrame, source_filename: str | None = None, k: int = 5) -> DataFrame:
    """Report figures as ``(section, item, value)`` rows: totals, affected tools, anomalies."""
    rows = _of_file(df, source_filename)
    figures = rows.agg(
        *[c.alias(n) for n, c in _figures().items() if n in ("total", "errors", "alarms")]
    )
    totals = figures.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit("figure").alias("section"), F.lit(n).alias("item"), F.col(n).alias("value"))
                    for n in ("total", "errors", "alarms")
                ]
            )
        )
    )
    tools = rows.groupBy("tool_id").agg(F.count(F.lit(1)).alias("value"))
    tools = tools.where(F.col("tool_id") != "").select(
        F.lit("tool").alias("section"), F.col("tool_id").alias("item"), "value"
    )
    anomalies = top_anomalies(rows, k=k).select(
        F.lit("anomaly").alias("section"), F.col("event_name").alias("item"), F.col("freq").alias("value")
    )
    return totals.unionByName(tools).unionByName(anomalies)


def extraction_coverage(df: DataFrame, *by: str) -> DataFrame:
    """Share of rows in which every mandatory field is filled."""
    filled = F.lit(True)
    for c in S.MANDATORY_LOG_FIELDS:
        filled = filled & (F.coalesce(F.col(c), F.lit("")) != "")
    return df.groupBy(*(by or ("source_filename", "source_format"))).agg(
        F.count(F.lit(1)).alias("records"), F.avg(filled.cast("double")).alias("coverage")
    )


def unmapped_columns(df: DataFrame) -> DataFrame:
    """``(source_filename, column)``: the columns of each file no rule could map."""
    names = F.from_json(
        F.get_json_object("metadata", "$.ai_unmapped_columns"), "array<string>"
    )
    return (
        df.where(F.col("metadata").contains('"ai_unmapped_columns"'))
        .select("source_filename", F.explode(names).alias("column"))
        .distinct()
    )


def first_warnings(warnings: DataFrame, k: int = 5) -> DataFrame:
    """The first warnings of each file. The ranked limit cuts each task's rows before the
    shuffle, so a file with many warnings stays small."""
    order = Window.partitionBy("source_filename").orderBy("block", "row", "warning")
    return warnings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def session_context(df: DataFrame, sample: int = S.DEFAULT_LIMITS["sample"]) -> DataFrame:
    """One row: the figures plus a JSON list of the newest rows."""
    newest = df.orderBy(F.desc("timestamp"), F.desc("id")).limit(sample)
    shown = ["timestamp", "id", "tool_id", "severity", "log_type", "event_name", "raw_message"]
    rows = newest.agg(
        F.sort_array(
            F.collect_list(F.struct(*[c for c in shown if c in df.columns])), asc=False
        ).alias("sample")
    ).select(F.to_json("sample").alias("sample"))
    return summary_stats(df).withColumn("sample", rows.scalar())

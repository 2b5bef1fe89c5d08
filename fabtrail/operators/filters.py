"""Filters, ordered reads and views over the log and recipe tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fabtrail import schema as S
from fabtrail.functions.rules import is_fault, severity_rank
from fabtrail.functions.text import ellipsis


def metadata_value(key: str, dtype: str = "string", column: str = "metadata") -> Column:
    """One field of the overflow column; null where the text is no JSON object or lacks it."""
    return F.try_variant_get(F.try_parse_json(column), f'$["{key}"]', dtype)


def has_metadata(key: str) -> Column:
    return metadata_value(key).isNotNull()


def field(df: DataFrame, name: str) -> Column:
    """A column of the table, else the overflow field of that name."""
    return F.col(name) if name in df.columns else metadata_value(name)


#: what a search looks into
SEARCHED = ("raw_message", "event_name", "normalized_message")


def search(term: str, df: DataFrame) -> Column:
    """Case-insensitive substring over message, event and display message.

    ``%`` and ``_`` in the term are wildcards.
    """
    pattern = f"%{term}%"
    hits = [F.coalesce(field(df, c).ilike(pattern), F.lit(False)) for c in SEARCHED]
    return reduce(lambda a, b: a | b, hits)


def log_predicates(
    df: DataFrame,
    *,
    tool_id: str | None = None,
    severity: str | None = None,
    log_type: str | None = None,
    start_ts: str | None = None,
    end_ts: str | None = None,
    search_term: str | None = None,
    source_filename: str | None = None,
    source_format: str | None = None,
) -> list[Column]:
    """One condition per argument that is given and not empty."""
    found = []
    if tool_id:
        found.append(F.col("tool_id") == tool_id)
    if severity:
        found.append(F.col("severity") == severity)
    if log_type:
        found.append(F.col("log_type") == log_type)
    if start_ts:
        found.append(F.col("timestamp") >= start_ts)
    if end_ts:
        found.append(F.col("timestamp") <= end_ts)
    if source_filename:
        found.append(F.col("source_filename") == source_filename)
    if source_format:
        found.append(F.col("source_format") == source_format)
    if search_term:
        found.append(search(search_term, df))
    return found


def filter_logs(df: DataFrame, **filters) -> DataFrame:
    """Rows meeting all given conditions."""
    return reduce(DataFrame.where, log_predicates(df, **filters), df)


def latest(df: DataFrame, limit: int) -> DataFrame:
    """The newest rows first; equal times by id, newest id first."""
    return df.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def query_logs(df: DataFrame, limit: int = S.DEFAULT_LIMITS["api"], **filters) -> DataFrame:
    return latest(filter_logs(df, **filters), limit)


def query_recipes(
    df: DataFrame,
    *,
    tool_id: str | None = None,
    recipe_id: str | None = None,
    source_filename: str | None = None,
    limit: int = S.DEFAULT_LIMITS["recipes"],
) -> DataFrame:
    if tool_id:
        df = df.where(F.col("tool_id") == tool_id)
    if recipe_id:
        df = df.where(field(df, "recipe_id") == recipe_id)
    if source_filename:
        df = df.where(F.col("source_filename") == source_filename)
    return latest(df, limit)


def live_view(df: DataFrame, limit: int = S.DEFAULT_LIMITS["live"]) -> DataFrame:
    """The newest rows that came from a stream, in the live columns."""
    return latest(df.where(F.col("source_filename").startswith("mqtt_")), limit).select(
        *[
            F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
            for c in S.LIVE_COLUMNS
        ]
    )


def drop_incomplete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a usable value in every column."""
    return df.dropna(subset=list(columns))


def faults(df: DataFrame) -> DataFrame:
    return df.where(is_fault(F.col("severity")))


def by_severity(df: DataFrame, worst_first: bool = True) -> DataFrame:
    rank = severity_rank(F.col("severity"))
    return df.withColumn("severity_rank", rank).orderBy(
        F.desc("severity_rank") if worst_first else F.asc("severity_rank"), "timestamp", "id"
    )


def flatten_metadata(df: DataFrame, keys: list[str]) -> DataFrame:
    """Overflow fields as columns; a column of the table wins over a field of its name."""
    return df.withColumns({k: metadata_value(k) for k in keys if k not in df.columns})


def with_variant(df: DataFrame) -> DataFrame:
    """The overflow column as a variant, for stores that keep it parsed."""
    return df.withColumn("metadata", F.try_parse_json("metadata"))


# -- views ------------------------------------------------------------------------------------


def display_view(df: DataFrame) -> DataFrame:
    """The display columns that exist."""
    return df.select(*[c for c in S.DISPLAY_COLUMNS if c in df.columns])


def summary_view(df: DataFrame) -> DataFrame:
    """One short line per row, as a terminal table shows it."""
    text = lambda c: F.coalesce(field(df, c).cast("string"), F.lit(""))
    value = field(df, "parameter_value").cast("double")
    return df.select(
        F.left("timestamp", F.lit(19)).alias("timestamp"),
        "tool_id",
        "severity",
        F.left(F.coalesce(field(df, "event_name"), F.col("raw_message")), F.lit(50)).alias("event"),
        text("parameter_name").alias("parameter_name"),
        F.when(value != 0, value).alias("parameter_value"),
        text("unit").alias("unit"),
        text("wafer_id").alias("wafer_id"),
    )


def clipped(df: DataFrame, width: int) -> DataFrame:
    """Rows with a long message cut and marked."""
    return df.withColumn("raw_message", ellipsis(F.col("raw_message"), width))

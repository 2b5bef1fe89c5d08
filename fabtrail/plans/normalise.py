"""Parsed records to canonical log rows: pure projections, no shuffle.

Line formats (key=value, syslog, text) trust the fields their parser found; all other
formats resolve every column by header mapping and column name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fabtrail import schema as S
from fabtrail.functions import entries as E
from fabtrail.functions import rules as R
from fabtrail.functions import text as X
from fabtrail.functions.timestamps import event_time, iso_timestamp
from fabtrail.session import barrier, conformed

#: columns a parsed frame may carry through normalisation
CARRIED = ["source_path", "block", "row", "job_id"]

#: the column of names that no rule knows, where it is asked for
UNMAPPED = "_unmapped"


def _carried(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in CARRIED if c in df.columns]


def is_recipe_file(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("recipe"))


def default_tool(name: Column) -> Column:
    return F.coalesce(X.empty_to_null(X.stem(name)), F.lit("UNKNOWN_TOOL"))


def reading_text(name: Column, value: Column, unit: Column) -> Column:
    """``| name=value unit`` part of a display message; null without name or value."""
    # callers pass plain columns
    return F.when(
        (name != "") & value.isNotNull(),
        F.concat(
            F.lit("| "), name, F.lit("="), X.number_text(value), F.coalesce(unit, F.lit(""))
        ),
    )


def display_message(tool: Column, severity: Column, event: Column, reading: Column) -> Column:
    return F.concat_ws(
        " ",
        F.concat(F.lit("["), tool, F.lit("]")),
        F.concat(severity, F.lit(":")),
        X.empty_to_null(event),
        reading,
    )


def missing_fields(mandatory: list[str]) -> Column:
    """Names of mandatory fields that are null or empty."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in mandatory])
    )


def _finish(df: DataFrame, ingest_ts: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Add the columns every path fills alike and put all in table order."""
    filled = {
        "id": F.expr("uuid()"),
        "drain_cluster_id": F.lit(None).cast("bigint"),
        "drain_template": F.lit(None).cast("string"),
        "ai_summary": F.lit(None).cast("string"),
        "ai_classification": F.lit(None).cast("string"),
        "ai_root_cause_hint": F.lit(None).cast("string"),
    }
    for name, col in filled.items():
        if name not in df.columns:
            df = df.withColumn(name, col)
    df = df.withColumn("event_ts", event_time(F.col("timestamp"), F.lit(ingest_ts)))
    return barrier(df.select(*conformed(df, S.LOGS), *_carried(df), *more))


def normalise_lines(df: DataFrame, ingest_ts: str) -> DataFrame:
    """Canonical rows of ``rec`` structs (see ``sources.lines``)."""
    rec, name = F.col("rec"), F.col("source_filename")
    raw = X.first_text(rec["raw_message"], rec["message"], rec["event_name"])
    stated = F.coalesce(R.severity_of(X.empty_to_null(rec["severity"])), F.lit("INFO"))
    tool = X.empty_to_null(rec["tool_id"])
    df = df.withColumns(
        {
            "timestamp": F.coalesce(X.empty_to_null(rec["timestamp"]), F.lit(ingest_ts)),
            "tool_id": F.when(tool.isNull() | (tool == "UNKNOWN"), default_tool(name)).otherwise(
                tool
            ),
            "raw_message": F.coalesce(raw, F.lit("")),
            "severity": R.promoted_severity(stated, F.coalesce(raw, F.lit(""))),
            "parameter_value": X.to_number(rec["parameter_value"]),
            **{
                c: X.blank_to_null(rec[c])
                for c in (
                    "event_name",
                    "recipe_id",
                    "wafer_id",
                    "process_stage",
                    "parameter_name",
                    "unit",
                    "alarm_code",
                )
            },
        }
    )
    event = F.coalesce(F.col("event_name"), F.lit(""))
    df = df.withColumn(
        "log_type", R.log_type_of(F.concat_ws(" ", event, F.col("raw_message")))
    ).withColumn(
        "normalized_message",
        display_message(
            F.col("tool_id"),
            F.col("severity"),
            event,
            reading_text(F.col("parameter_name"), F.col("parameter_value"), F.col("unit")),
        ),
    )
    fixed = X.typed_members(
        {
            "process": (X.blank_to_null(rec["process"]), "S"),
            "message": (X.blank_to_null(rec["message"]), "S"),
            **{
                c: (F.col(c), "N" if c == "parameter_value" else "S")
                for c in (
                    "event_name",
                    "recipe_id",
                    "wafer_id",
                    "process_stage",
                    "alarm_code",
                    "parameter_name",
                    "parameter_value",
                    "unit",
                    "normalized_message",
                )
            },
        }
    )
    df = df.withColumn(
        "metadata", X.json_object(F.concat(fixed, X.json_members(rec["extras"])))
    ).withColumn("step_number", F.lit(None).cast("int"))
    return _finish(df, ingest_ts)


# -- structured ---------------------------------------------------------------------------


def _values(field: str) -> Column:
    """Entries resolved to ``field`` that have a value, in source order."""
    return F.filter(
        F.col("_fields"), lambda e: (e["target"] == field) & e["value"].isNotNull()
    )


def _last(field: str) -> Column:
    return E.as_text(F.try_element_at(_values(field), F.lit(-1)))


def _exact(name: str) -> Column:
    """Value of the column with this very name, if not empty."""
    hit = F.get(F.filter(F.col("_fields"), lambda e: e["key"] == name), F.lit(0))
    return X.empty_to_null(E.as_text(hit))


def unmapped_keys(keys: Column, mapping: Column | None = None) -> Column:
    """Column names that neither the mapping nor the name rules know."""
    unknown = F.filter(keys, lambda k: R.alias_field(k).isNull())
    if mapping is None:
        return unknown
    return X.let(
        _mapped_names(mapping),
        lambda names: F.filter(unknown, lambda k: ~F.array_contains(names, k)),
    )


def _mapped_names(mapping: Column) -> Column:
    """Names a mapping covers: its keys as they are and in lower case."""
    names = F.coalesce(F.map_keys(mapping), F.array().cast("array<string>"))
    return F.array_union(names, F.transform(names, F.lower))


def normalise_entries(
    df: DataFrame,
    ingest_ts: str,
    *,
    mapping: str | None = None,
    classify_structured: bool = False,
    strict_wafer: bool = False,
    keep_unmapped: bool = False,
) -> DataFrame:
    """Canonical rows of ``entries`` arrays; ``mapping`` names a map column of header mappings.

    ``keep_unmapped`` leaves the names of unmapped columns beside the rows, for what would else read them out of the overflow.
    """
    name = F.col("source_filename")
    map_col = F.col(mapping) if mapping else None
    df = df.withColumn(
        "_fields",
        F.transform(
            F.col("entries"),
            lambda e: F.struct(
                e["key"].alias("key"),
                e["value"].alias("value"),
                e["kind"].alias("kind"),
                R.target_field(e["key"], map_col).alias("target"),
            ),
        ),
    )
    fields = F.col("_fields")
    recipe = is_recipe_file(name)

    # times: the last that is not empty; ISO where it can be read
    stamps = F.filter(
        fields,
        lambda e: (e["target"] == "timestamp") & ~F.coalesce(e["value"], F.lit("")).isin("", "0"),
    )
    stamp = E.as_text(F.try_element_at(stamps, F.lit(-1)))
    # tools: a column of that very name, else the first stated one
    named_tool = _exact("tool_id")
    tools = F.filter(_values("tool_id"), lambda e: e["value"] != "UNKNOWN")
    tool = F.coalesce(
        F.when(named_tool != "UNKNOWN", named_tool), E.as_text(F.get(tools, F.lit(0)))
    )
    parts = F.transform(
        F.filter(
            fields,
            lambda e: ((e["target"] == "event_name") & e["value"].isNotNull())
            | (e["target"].isNull() & (e["kind"] == "S") & (X.strip(e["value"]) != "")),
        ),
        lambda e: F.when(e["target"].isNotNull(), E.as_text(e)).otherwise(
            F.concat(e["key"], F.lit("="), e["value"])
        ),
    )
    # a column without a target is unmapped, unless the mapping has it in another case
    unmapped = E.keys(F.filter(fields, lambda e: e["target"].isNull()))
    if mapping:
        unmapped = F.array_except(unmapped, _mapped_names(map_col))
    has_raw = F.exists(fields, lambda e: e["key"] == "raw_message")
    whole = X.json_object(X.json_members(fields))

    df = df.withColumns(
        {
            "timestamp": F.coalesce(
                iso_timestamp(stamp, F.lit(ingest_ts)), _exact("timestamp"), F.lit(ingest_ts)
            ),
            "tool_id": F.coalesce(X.empty_to_null(tool), default_tool(name)),
            "severity": F.coalesce(
                F.when(F.size(_values("severity")) > 0, R.severity_of(_last("severity"))),
                F.lit("INFO"),
            ),
            "event_name": _last("event_name"),
            "recipe_id": _last("recipe_id"),
            "wafer_id": _last("wafer_id"),
            "process_stage": _last("process_stage"),
            "parameter_name": R.parameter_name_of(_last("parameter_name")),
            "parameter_value": X.to_number(_last("parameter_value")),
            "unit": _last("unit"),
            "alarm_code": _exact("alarm_code"),
            "_step_stated": X.first_text(_exact("step_number")),
            "_unmapped": unmapped,
            "raw_message": F.when(has_raw, F.coalesce(_exact("raw_message"), whole))
            .when(F.size(parts) > 0, F.array_join(parts, " | "))
            .otherwise(whole),
            "log_type": F.coalesce(_exact("log_type"), F.lit("info")),
        }
    )
    event = F.coalesce(F.col("event_name"), F.lit(""))
    df = df.withColumn(
        "normalized_message",
        display_message(
            F.col("tool_id"),
            F.col("severity"),
            event,
            reading_text(F.col("parameter_name"), F.col("parameter_value"), F.col("unit")),
        ),
    ).withColumn("_combined", F.concat_ws(" ", event, F.col("raw_message")))

    # what the columns did not say, read from the text
    lowered = F.lower(F.col("_combined"))
    found = X.capture(F.regexp_replace(event, "[\n\r]", " "), R.PARAMETER_IN_TEXT, 3)
    no_param = X.empty_to_null(F.col("parameter_name")).isNull()
    wafer_pattern = R.STRICT_WAFER_IN_TEXT if strict_wafer else R.WAFER_IN_TEXT
    wafer_text = F.col("_combined") if strict_wafer else lowered
    df = df.withColumn("_found", F.when(no_param, found))
    hit = F.col("_found").isNotNull()
    stated_step = F.col("_step_stated").isNotNull() & (F.col("_step_stated") != "0")
    df = df.withColumns(
        {
            "tool_id": F.when(
                F.col("tool_id") == "UNKNOWN_TOOL",
                F.coalesce(
                    X.empty_to_null(F.regexp_extract(event, R.TOOL_IN_TEXT, 1)), F.col("tool_id")
                ),
            ).otherwise(F.col("tool_id")),
            "parameter_name": F.when(
                hit, R.parameter_name_of(X.group(F.col("_found"), 1))
            ).otherwise(F.col("parameter_name")),
            "parameter_value": F.when(hit, X.to_number(X.group(F.col("_found"), 2))).otherwise(
                F.col("parameter_value")
            ),
            "unit": F.when(hit, F.coalesce(X.group(F.col("_found"), 3), F.col("unit"))).otherwise(
                F.col("unit")
            ),
            "wafer_id": F.coalesce(
                X.empty_to_null(F.col("wafer_id")),
                X.empty_to_null(F.regexp_extract(wafer_text, wafer_pattern, 1)),
            ),
            "step_number": F.when(stated_step, F.col("_step_stated").try_cast("int")).otherwise(
                X.empty_to_null(F.regexp_extract(lowered, R.STEP_IN_TEXT, 1)).try_cast("int")
            ),
        }
    )
    if classify_structured:
        df = df.withColumn("log_type", R.log_type_of(F.col("_combined")))
    df = df.withColumn("log_type", F.when(recipe, F.lit("recipe")).otherwise(F.col("log_type")))
    df = df.withColumn(
        "recipe_id", F.coalesce(F.col("recipe_id"), F.when(recipe, F.lit("UNKNOWN")))
    )

    # overflow: the resolved fields, what only recipes have, then all other columns as they came
    fixed = X.typed_members(
        {
            **{
                c: (F.col(c), "N" if c in ("parameter_value", "step_number") else "S")
                for c in (
                    "event_name",
                    "recipe_id",
                    "wafer_id",
                    "process_stage",
                    "parameter_name",
                    "parameter_value",
                    "unit",
                )
            },
            "step_number": (F.when(~stated_step, F.col("step_number")), "N"),
            "normalized_message": (F.col("normalized_message"), "S"),
            "setpoint_name": (
                F.when(recipe, F.coalesce(F.col("parameter_name"), F.lit("UNKNOWN"))),
                "S",
            ),
            "setpoint_value": (
                F.when(recipe, F.coalesce(F.col("parameter_value"), F.lit(0.0))),
                "N",
            ),
        }
    )
    noted = F.when(
        F.size("_unmapped") > 0,
        F.array(F.concat(F.lit('"ai_unmapped_columns": '), F.to_json("_unmapped"))),
    ).otherwise(F.array().cast("array<string>"))
    # a derived value takes the place of a column of the same name
    read_step = ~stated_step & F.col("step_number").isNotNull()
    own = F.filter(
        fields,
        lambda e: e["target"].isNull()
        & ~e["key"].isin("normalized_message", "ai_unmapped_columns")
        & ~(read_step & (e["key"] == "step_number")),
    )
    df = df.withColumn(
        "metadata", X.json_object(F.concat(fixed, X.json_members(own), noted))
    )
    return _finish(df, ingest_ts, (UNMAPPED,) if keep_unmapped else ())

"""Lookups by signature, fingerprint, file name and id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fabtrail.operators.ordering import lookup_join


def newest_per(df: DataFrame, key: str, order: str = "created_at") -> DataFrame:
    """One row per key, the newest. The ranked limit cuts rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("id")))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


#: arrival order of rows, where a frame has it
ARRIVAL = "_arrival"


def arrived(df: DataFrame) -> DataFrame:
    """Rows with their place in the frame, unless they have it already."""
    return df if ARRIVAL in df.columns else df.withColumn(ARRIVAL, F.monotonically_increasing_id())


def first_per(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the one that came first."""
    return _one_per(df, key, F.min_by)


def last_per(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the one that came last."""
    return _one_per(df, key, F.max_by)


def _one_per(df: DataFrame, key: str, pick) -> DataFrame:
    rows = arrived(df)
    whole = F.struct(*[c for c in rows.columns if c != ARRIVAL])
    # nulls are keys of their own
    return rows.groupBy(F.col(key).alias("_key")).agg(pick(whole, F.col(ARRIVAL)).alias("_row")).select("_row.*")


def match_templates(files: DataFrame, templates: DataFrame) -> DataFrame:
    """Files with the name and field mapping of the template saved for their signature."""
    known = newest_per(templates, "file_signature").select(
        F.col("file_signature").alias("signature"),
        F.col("name").alias("template_name"),
        F.col("field_mapping").alias("template_mapping"),
    )
    return lookup_join(files, known, ["signature"])


def match_headers(records: DataFrame, mappings: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Records with the ``mapping`` cached for their header fingerprint; null on a miss."""
    known = mappings.select(F.col("header_fingerprint").alias(fingerprint), "mapping")
    return lookup_join(records, known, [fingerprint])


def mapping_of_file(mappings: DataFrame, files: DataFrame) -> DataFrame:
    """Files with the mapping stored under their name (the oldest if there are several)."""
    first = mappings.groupBy("source_filename").agg(
        F.min_by("mapping", F.struct("created_at", "header_fingerprint")).alias("mapping")
    )
    return lookup_join(files, first, ["source_filename"])


def apply_enrichment(logs: DataFrame, results: DataFrame) -> DataFrame:
    """Set summary, classification and hint from ``(id, summary, classification,
    root_cause_hint)`` rows, the last of an id; rows without a result stay as they are."""
    found = last_per(results, "id").select(
        "id",
        F.col("summary").alias("_summary"),
        F.col("classification").alias("_classification"),
        F.col("root_cause_hint").alias("_hint"),
        F.lit(True).alias("_hit"),
    )
    joined = logs.join(found, "id", "left")
    pick = lambda new, old: F.when(F.col("_hit"), F.col(new)).otherwise(F.col(old)).alias(old)
    changed = {
        "ai_summary": pick("_summary", "ai_summary"),
        "ai_classification": pick("_classification", "ai_classification"),
        "ai_root_cause_hint": pick("_hint", "ai_root_cause_hint"),
    }
    return joined.select(*[changed.get(c, F.col(c)) for c in logs.columns])


def apply_edits(pending: DataFrame, edits: DataFrame) -> DataFrame:
    """Staged rows with the last edited ``record_data`` where ``edits`` has their id."""
    new = last_per(edits, "id").select("id", F.col("record_data").alias("_edited"))
    joined = pending.join(new, "id", "left")
    return joined.withColumn("record_data", F.coalesce("_edited", "record_data")).select(
        *pending.columns
    )


def not_present(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New rows whose key the table does not have; of several with one key the first."""
    return first_per(new, key).join(existing.select(key), key, "left_anti").select(
        *[c for c in new.columns if c != ARRIVAL]
    )

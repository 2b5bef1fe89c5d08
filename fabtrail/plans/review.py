"""Human review of records from files of unknown format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fabtrail import schema as S
from fabtrail.functions import entries as E
from fabtrail.functions import text as X
from fabtrail.functions.text import empty_to_null
from fabtrail.operators.lookups import apply_edits
from fabtrail.plans.normalise import normalise_entries

REVIEW_FORMAT = "llm_parsed"


def split_for_review(
    logs: DataFrame, job_id: Column | None = None, review: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows to stage). A file has one format, so its rows go one way together."""
    held = F.col("source_format") == REVIEW_FORMAT
    if not review:
        held = F.lit(False)
    return logs.where(~held), to_pending(logs.where(held), job_id)


def to_pending(logs: DataFrame, job_id: Column | None = None) -> DataFrame:
    """Log rows as staged rows; a job is a file unless said otherwise."""
    seq = F.col("row") if "row" in logs.columns else F.monotonically_increasing_id()
    return logs.select(
        "id",
        (F.col("source_filename") if job_id is None else job_id).alias("job_id"),
        F.col("source_filename").alias("filename"),
        seq.alias("seq"),
        F.to_json(F.struct(*S.CORE_COLUMNS)).alias("record_data"),
        F.lit(None).cast("string").alias("field_mapping"),
        F.lit(0).alias("approved"),
    )


def review_grid(pending: DataFrame) -> DataFrame:
    """The editable fields of staged rows: of the record, else of its overflow, else ''."""
    df = pending.withColumn("_overflow", F.get_json_object("record_data", "$.metadata"))

    def value(name: str) -> Column:
        found = [
            empty_to_null(F.get_json_object(c, f"$.{name}")) for c in ("record_data", "_overflow")
        ]
        return F.coalesce(*found, F.lit(""))

    return df.select(
        "id", "job_id", "filename", "seq", *[value(c).alias(c) for c in S.REVIEW_FIELDS]
    )


def approved_logs(pending: DataFrame, edits: DataFrame | None, ingest_ts: str) -> DataFrame:
    """Staged rows, as edited, normalised again to log rows; their ids are kept."""
    rows = pending if edits is None else apply_edits(pending, edits)
    grid = review_grid(rows)
    filled = F.filter(
        F.array(
            *[E.entry(F.lit(c), empty_to_null(F.col(c)), F.lit("S")) for c in S.REVIEW_FIELDS]
        ),
        lambda e: e["value"].isNotNull(),
    )
    records = grid.select(
        "id",
        F.col("filename").alias("source_filename"),
        F.lit(REVIEW_FORMAT).alias("source_format"),
        F.col("seq").alias("row"),
        filled.alias("entries"),
    )
    return normalise_entries(records, ingest_ts)


def template_mapping(pending: DataFrame) -> DataFrame:
    """Per job the fields filled in its first row, each mapped to itself."""
    grid = review_grid(pending)
    first = grid.groupBy("job_id").agg(
        F.min_by(F.struct(*S.REVIEW_FIELDS), F.col("seq")).alias("_first")
    )
    names = F.filter(
        F.array(*[F.when(F.col(f"_first.{c}") != "", F.lit(c)) for c in S.REVIEW_FIELDS]),
        lambda n: n.isNotNull(),
    )
    return first.select("job_id", F.map_from_arrays(names, names).alias("field_mapping"))


def new_template(
    pending: DataFrame, signature: Column, name: Column, preview: Column, created_at: str
) -> DataFrame:
    """Template rows for the jobs of staged rows; the preview keeps 500 characters."""
    mapped = template_mapping(pending).withColumn("filename", F.col("job_id"))
    return mapped.select(
        F.expr("uuid()").alias("id"),
        name.alias("name"),
        signature.alias("file_signature"),
        "field_mapping",
        F.left(preview, F.lit(500)).alias("sample_preview"),
        F.lit(created_at).alias("created_at"),
    )


def remap(entries: Column, mapping: Column) -> Column:
    """Entries with the mapped names first, then all fields whose name is not taken yet."""

    def renamed(by_key: Column) -> Column:
        found = F.transform(
            F.map_entries(mapping),
            lambda m: E.entry(m["value"], F.try_element_at(by_key, m["key"]), F.lit("S")),
        )
        return F.filter(found, lambda e: e["value"].isNotNull())

    def with_rest(first: Column) -> Column:
        rest = X.let(
            E.keys(first),
            lambda taken: F.filter(entries, lambda e: ~F.array_contains(taken, e["key"])),
        )
        return E.dedupe(F.concat(first, rest))

    return F.when(mapping.isNull(), entries).otherwise(
        X.let(X.let(E.as_map(entries), renamed), with_rest)
    )

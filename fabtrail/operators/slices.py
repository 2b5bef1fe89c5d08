"""What each stored file of log rows may hold, so that a search skips the files that cannot have a hit.

Of each Parquet file the first and last time is kept, and a bitmap of fixed size of the hashed trigrams of its searched texts and of
its tools. A file is read only if its times meet the range that is asked for and all trigrams of the term's literal parts are in its
bitmap. False alarms only cost a read; rows are always filtered again. Files without an entry are always read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fabtrail.functions.text import once
from fabtrail.operators.filters import SEARCHED, field

#: slots of a file's bitmap (32 KB, fixed) and of one stored row of it
SLOTS, BUCKET = 1 << 18, 1 << 15

SLICES = "file string, first_ts string, last_ts string, bucket int, bits binary"


def _slot(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(SLOTS)).cast("int")


def trigram_slots(text: Column) -> Column:
    """Slots of the trigrams of a text; none for fewer than three characters, null for null."""

    def of_characters(c: Column) -> Column:
        grams = F.transform(F.slice(c, 1, F.greatest(F.size(c) - 2, F.lit(0))), lambda x, i: _slot(x, F.get(c, i + 1), F.get(c, i + 2)))
        return F.array_distinct(grams)

    return once(F.split(text, ""), of_characters)


def tool_slot(tool_id: Column) -> Column:
    return _slot(F.lit("tool"), tool_id)


def slice_index(rows: DataFrame) -> DataFrame:
    """The entries (:data:`SLICES`) of the files that ``rows`` are read from.

    Only distinct slots of a file are shuffled, at most :data:`SLOTS` for each task that reads of it.
    """
    file = F.col("_metadata.file_path").alias("file")
    times = rows.groupBy(file).agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    slots = F.flatten(
        F.array(
            *[F.coalesce(trigram_slots(F.lower(field(rows, c))), F.array().cast("array<int>")) for c in SEARCHED],
            F.array(tool_slot(F.col("tool_id"))),
        )
    )
    held = rows.select(file, F.explode(slots).alias("slot")).dropDuplicates(["file", "slot"])
    bits = held.groupBy("file", F.floor(F.col("slot") / BUCKET).cast("int").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("slot") % BUCKET).alias("bits")
    )
    return times.join(bits, "file").select("file", "first_ts", "last_ts", "bucket", "bits")


def wanted_slots(spark: SparkSession, search_term: str | None, tool_id: str | None) -> list[int]:
    """Slots that a file with a hit must have: of the parts of the term between wildcards, and of the tool."""
    parts = F.split(F.lower(F.lit(f"%{search_term or ''}%")), r"[%_\\]")
    slots = F.flatten(F.transform(parts, trigram_slots))
    if tool_id:
        slots = F.array_append(slots, tool_slot(F.lit(tool_id)))
    # bounded by the length of the term
    return spark.range(1).select(F.array_sort(F.array_distinct(slots))).first()[0]


def _has_bit(bits: Column, place: int) -> Column:
    byte = F.conv(F.hex(F.substring(bits, place // 8 + 1, 1)), 16, 10).cast("int")
    return byte.bitwiseAND(F.lit(1 << place % 8)) != 0


def may_hold(
    index: DataFrame,
    *,
    search_term: str | None = None,
    tool_id: str | None = None,
    start_ts: str | None = None,
    end_ts: str | None = None,
) -> DataFrame:
    """``file, may``: for each file with an entry, whether it may have a row that meets all conditions."""
    by_bucket: dict[int, list[int]] = {}
    for slot in wanted_slots(index.sparkSession, search_term, tool_id):
        by_bucket.setdefault(slot // BUCKET, []).append(slot % BUCKET)
    met = F.lit(False)
    for bucket, places in by_bucket.items():
        has = F.lit(True)
        for place in places:
            has = has & _has_bit(F.col("bits"), place)
        met = F.when(F.col("bucket") == bucket, has).otherwise(met)
    found = index.groupBy("file").agg(
        F.count_if(met).alias("met"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )
    may = F.col("met") == len(by_bucket)
    # a file without times has no row in any range
    if start_ts:
        may = may & F.coalesce(F.col("last_ts") >= start_ts, F.lit(False))
    if end_ts:
        may = may & F.coalesce(F.col("first_ts") <= end_ts, F.lit(False))
    return found.select("file", may.alias("may"))

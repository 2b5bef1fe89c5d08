"""Exact deduplication by two passes over hashes with Bloom filters, in DataFrame functions only.

Pass one counts the slots that the hashes of all texts fall into and keeps, as bitmaps, the slots met
more than once. A text whose slots are not all among them has no equal: it passes straight
through. Only the other rows, of which few are false alarms, are shuffled and grouped by their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fabtrail.session import stored, stored_in_few

#: bits of one bitmap of Spark's bitmap functions
BITMAP_BITS = 32768

#: the filter has at least this many bits a row …
BITS_PER_ROW = 16

#: … but never more than 2 ** 29 (64 MB), which bounds what is broadcast; beyond it more rows are false alarms
MOST_BITS = 1 << 29

#: probes per hash
PROBES = 2

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def filter_bits(rows: int) -> int:
    """A power of two, from one bitmap up to ``MOST_BITS``."""
    return min(MOST_BITS, max(BITMAP_BITS, 1 << (rows * BITS_PER_ROW - 1).bit_length()))


def _slots(sha: Column, bits: int) -> list[Column]:
    """Independent slots 0 … bits-1, cut from the hash's hex digits."""
    cut = lambda i: F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("bigint")
    return [F.pmod(cut(i), F.lit(bits)) for i in range(PROBES)]


def repeated_slots(digests: DataFrame, bits: int) -> DataFrame:
    """Bitmaps (``bucket``, ``bitmap``) of the slots that at least two rows fall into.

    A row's own probes count once each slot, so a lone row never marks its slots as repeated.
    """
    slot = F.explode(F.array_distinct(F.array(*_slots(F.col("text_sha256"), bits))))
    return (
        digests.select(slot.alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .groupBy(F.floor(F.col("slot") / BITMAP_BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bitmap"))
    )


def possibly_repeated(digests: DataFrame, bits: int) -> DataFrame:
    """The rows with a flag ``again``: all their slots are met more than once."""
    bitmaps = repeated_slots(digests, bits)
    out = digests
    again = F.lit(True)
    for i, slot in enumerate(_slots(F.col("text_sha256"), bits)):
        # at most MOST_BITS / BITMAP_BITS rows of 4 KB each
        found = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_b{i}"), F.col("bitmap").alias(f"_m{i}")))
        out = out.withColumn(f"_s{i}", slot).join(
            found, F.floor(F.col(f"_s{i}") / BITMAP_BITS) == F.col(f"_b{i}"), "left"
        )
        inner = F.col(f"_s{i}") % BITMAP_BITS
        byte = F.conv(F.hex(F.substring(F.col(f"_m{i}"), F.floor(inner / 8).cast("int") + 1, F.lit(1))), 16, 10)
        bit = F.getbit(byte.cast("bigint"), (inner % 8).cast("int"))
        again = again & F.coalesce(bit == 1, F.lit(False))
    return out.withColumn("again", again).select(*digests.columns, "again")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of white space became one space; null counts
    as empty, so null and empty texts form one group. Of equal texts the row with the smallest doc_id
    stays (a null doc_id comes last). Of rows that repeat a doc_id and its text exactly one stays. Other columns
    are not read. An empty table gives an empty result.
    """
    digests = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.sha2(normalised(F.col("text")), 256).alias("text_sha256"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    rows = digests.count()
    flagged = possibly_repeated(digests, filter_bits(rows))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    suspects = flagged.where("again").drop("again")
    groups = suspects.groupBy("text_sha256").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    # stored, so that both sides of the join are shuffled anew and a large group's rows can be split
    groups = stored_in_few(groups, "groups", rows)
    met = suspects.join(groups, "text_sha256").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )
    alone = flagged.where(~F.col("again")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(met)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the later ones of equal texts, all columns as they were.

    Rows whose doc_id occurs once are chosen by doc_id. Rows that repeat a doc_id are told apart by
    their text's hash, and of rows equal in both one stays.
    """
    groups = exact_groups(docs)
    kept = groups.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(normalised(F.col("text")), 256)
    own = docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("bigint").alias("_id0"), sha.alias("_sha0"))
    out = own.join(kept, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_sha0") == F.col("_sha")), "left_semi")
    again = groups.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if not again.isEmpty():
        # rows with the doc_id and text of the row that stays came through the join with it
        out = out.dropDuplicates(["_id0", "_sha0"])
    return out.select("document.*")


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""

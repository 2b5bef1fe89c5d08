"""Harmonic packing of documents into sequences of fixed capacity.

A piece of length in (C / (k+1), C / k] belongs to class k, and a bin of class k takes exactly k pieces, whichever
they are: bins are filled by counting, with no look at other bins. Each document is cut so that its
pieces nearly fill their class's share: whole sequences first, then halves (C/2, C/4 …), which fill
classes 2, 4 … without padding, until the rest wastes little of its share.

Pieces of a class are numbered by prefix sums over slices, so all bins but a class's last are full, on however many
workers. The pieces of the last bins (one a class at most, so bounded) are put where they fit first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fabtrail.llm.words import text_slices, word_encoder
from fabtrail.session import stored, stored_in_few

CAPACITY = 4096

#: a rest is cut further while its class would leave more than this part of the capacity's share empty …
SLACK = 1 / 64

#: … and it is longer than this; shorter rests are never cut
SHORTEST_CUT = 64

#: pieces are numbered in slices of about this many, up to MOST_SLICES
SLICE_PIECES = 2_000
MOST_SLICES = 1 << 16


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, in order."""
    pieces = [capacity] * (length // capacity)
    rest, half = length % capacity, capacity
    while rest:
        share = capacity // (capacity // rest)
        if rest <= SHORTEST_CUT or share - rest <= SLACK * rest:
            pieces.append(rest)
            break
        while half > rest:
            half //= 2
        pieces.append(half)
        rest -= half
    return pieces


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, row, start, length, ids_crc32, doc_tokens, class``: the pieces of all documents."""

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            # the more words at once, the fewer look-ups
            for part in text_slices(batch, limit=8 << 20):
                ids, bounds = encoder.encode(part.column("text"), end_id)
                view = memoryview(ids.astype("<u4")).cast("B")
                owner, start, length, crc = [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    at = a
                    for n in cut(b - a, capacity):
                        owner.append(i)
                        start.append(at - a)
                        length.append(n)
                        crc.append(zlib.crc32(view[4 * at : 4 * (at + n)]))
                        at += n
                owner, lengths = np.array(owner, np.int64), np.array(length, np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id").take(pa.array(owner)), "row": part.column("row").take(pa.array(owner)),
                     "start": pa.array(start, pa.int64()), "length": pa.array(lengths),
                     "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(np.diff(bounds)[owner], pa.int64()),
                     "class": pa.array((capacity // lengths).astype(np.int32))}
                )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    schema = "doc_id bigint, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int"
    return rows.mapInArrow(cut_all, schema)


def _numbered(pieces: DataFrame, slices: int) -> DataFrame:
    """``rank`` 0, 1, 2 … in each class, and ``in_class``, the class's size."""
    cut_up = pieces.withColumn("slice", F.pmod(F.xxhash64("row", "start"), F.lit(slices)))
    counts = cut_up.groupBy("class", "slice").agg(F.count(F.lit(1)).alias("n"))
    per_class = Window.partitionBy("class")
    starts = counts.select(
        F.col("class").alias("_class"),
        F.col("slice").alias("_slice"),
        F.coalesce(F.sum("n").over(per_class.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"),
        F.sum("n").over(per_class).alias("in_class"),
    )
    inside = F.row_number().over(Window.partitionBy("class", "slice").orderBy("row", "start")) - 1
    same = (F.col("class") == F.col("_class")) & (F.col("slice") == F.col("_slice"))
    return (
        cut_up.withColumn("place", inside)
        .join(starts, same)
        .withColumn("rank", F.col("first") + F.col("place"))
        .drop("_class", "_slice", "first", "place", "slice")
    )


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, capacity``.

    A document's ids are those of its whole text (null: empty) and ``end_id``; so an empty text is one piece of length
    1. Each id lies in one piece and each piece in one sequence; a sequence's pieces lie end to end from offset 0. Rows that repeat
    a doc_id are documents of their own. Other columns are not read. Sequence ids are unique, not dense.
    """
    pieces = stored(pieces_of(docs, tokenizer, end_id, capacity), "pieces")
    n = pieces.count()
    slices = min(MOST_SLICES, max(1, n // SLICE_PIECES))
    ranked = stored_in_few(_numbered(pieces, slices), "ranked", n)
    size = F.col("class")
    full = F.col("rank") < F.floor(F.col("in_class") / size) * size
    # class and bin number make the id; a class has fewer than 2 ** 40 bins
    in_bins = ranked.where(full).withColumn(
        "sequence_id", F.col("class").cast("bigint") * (1 << 40) + F.floor(F.col("rank") / size)
    )
    earlier = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    in_bins = in_bins.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    # fewer than k pieces of class k, together shorter than one sequence: bounded by the classes, whatever the input
    rests = ranked.where(~full)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fitted = _first_fit(rests, capacity)
    return in_bins.select(*columns).unionByName(fitted.select(*columns))


def _first_fit(rests: DataFrame, capacity: int) -> DataFrame:
    """Put the few left-over pieces into sequences, longer pieces first, each where it fits first."""

    def fit(frame):
        frame = frame.sort_values(["length", "row", "start"], ascending=[False, True, True])
        free: list[int] = []
        where, offset = [], []
        for n in frame["length"].tolist():
            k = next((k for k, room in enumerate(free) if room >= n), len(free))
            if k == len(free):
                free.append(capacity)
            where.append(k)
            offset.append(capacity - free[k])
            free[k] -= n
        return frame.assign(sequence_id=where, offset=offset)

    schema = T.StructType([*rests.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    together = rests.withColumn("all", F.lit(0)).groupBy("all")
    return together.applyInPandas(lambda frame: fit(frame.drop(columns="all")), schema)

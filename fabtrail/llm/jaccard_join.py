"""Exact n-gram Jaccard self-join by pivots, Voronoi regions and triangle-inequality windows.

The Jaccard distance of shingle sets is a metric. Two texts that share no shingle are at distance 1, and so is nearly every
pair, so whole documents as pivots would tell almost nothing apart. The first pivots are therefore the one-shingle sets:
a document lies nearest to the pivots of its own shingles, and in the region of the first of them in one global
order. Its boundary window reaches over its next pivots: of n shingles, a partner at similarity t shares at least
one of the first n - ceil(t n) + 1. Shingles in few documents come first, so regions are small. The place of the region's shingle in
a member's order bounds what it can share with a partner whose first common shingle it is, and so the partner's size
(``most``). The smaller of two partners must be allowed one of its own size at least: members that only share a passage, which is late in all their orders,
leave the region before any of them meet.

Inside a region, documents are pivots. The distance of all members to one pivot gives its ball (linked to the pivot, so
one component), the shell up to twice the radius, and the rest. Only members within the triangle
inequality's reach of each other stay together for the next pivot: the ball's inner part is done, its outer part stays
for the shell. Each member knows the ball it belongs to, as members of one ball need not meet, but those of two balls
must. Regions that have become small are joined pair by pair; regions that many unlike documents share
after the last round are joined in blocks, so no link is lost. Links are decided on whole shingle sets.

Equal shingle sets are one class from the start. Classes are told apart by a 64-bit hash of the set, shingles by
56 bits of theirs, and in the final measurement by 40.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fabtrail.llm.graph import components
from fabtrail.llm.words import hash_words, mix, owners, split_words, sums, text_slices
from fabtrail.session import stored, stored_in_few

WORDS = 5

#: similarity in hundredths
SIMILARITY = 80

#: counters of the sketch that orders shingles: a fixed 2 ** 20, sent to all tasks as one byte each (1 MB)
SKETCH_BITS, CHUNK = 20, 1 << 16

#: bits of a shingle's hash that are shipped and compared when sets are measured
MEMBER_BITS = 40

#: bits of the filter of classes whose sets are needed (4 MB, fixed); more classes mean more false alarms only
FILTER_BITS = 1 << 25

#: regions up to this size are joined pair by pair; larger ones go through rounds of pivots first
LEAF = 12
MOST_ROUNDS = 5

#: larger regions left after the rounds are joined in blocks of this many members
BLOCK = 64

_STEP = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SALT, _CLASS_SALT = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def _place_salt(k: int) -> np.uint64:
    return np.uint64((k + 1) * int(_SALT) % (1 << 64))


# -- sets, inside a task ------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after the other, and their bounds.

    Shingles are ``n`` lower-cased words (A-Z only); a text of fewer words is one shingle, one without words has none.
    """
    words, word_bounds = split_words(texts, lower=True)
    hashes = hash_words(words)[0]
    count = np.diff(word_bounds)
    owner = owners(word_bounds)
    total = len(hashes)
    value = np.zeros(total, np.uint64)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    left = word_bounds[1:][owner] - np.arange(total)
    for k in range(n):
        # words beyond the text's end add nothing; the number of words tells short texts apart
        value += np.where(left > k, padded[k : k + total] * _STEP[k % len(_STEP)] + _place_salt(k), np.uint64(0))
    value = mix(value)
    first = np.zeros(total, bool)
    first[word_bounds[:-1][count > 0]] = True
    keep = (left >= n) | (first & (count[owner] < n))
    value, owner = value[keep], owner[keep]
    value, owner = _sorted_within(value, owner)
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


def _sorted_within(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted inside each owner; owners are ascending."""
    order = np.argsort(value)
    small = owner.astype(np.uint16) if len(owner) and owner[-1] < 1 << 16 else owner
    order = order[np.argsort(small[order], kind="stable")]
    return value[order], owner[order]


def set_classes(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set that does not depend on the order."""
    size = np.diff(bounds).astype(np.uint64)
    return mix(sums(mix(value ^ _CLASS_SALT), bounds) + size * _SALT).view(np.int64)


def packed_set(value: np.ndarray) -> bytes:
    """The high ``MEMBER_BITS`` bits of sorted numbers, without loss.

    Sorted numbers repeat their own high bits: of ``n`` the ``log2 n`` highest are written as gaps in unary, about two
    bits a number, and only the rest in full.
    """
    n = len(value)
    if not n:
        return b""
    value = value >> np.uint64(64 - MEMBER_BITS)
    low = MEMBER_BITS + 1 - n.bit_length()
    marks = np.zeros(n + (1 << MEMBER_BITS - low), np.uint8)
    marks[(value >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    parts = [n.to_bytes(4, "little"), np.packbits(marks).tobytes()]
    rest = (value << np.uint64(64 - low)).astype(">u8").view(np.uint8).reshape(n, 8)
    for k in range(0, n, CHUNK):
        parts.append(np.packbits(np.unpackbits(rest[k : k + CHUNK], axis=1, count=low)).tobytes())
    return b"".join(parts)


def unpacked_set(data) -> np.ndarray:
    """The numbers of :func:`packed_set`."""
    data = np.frombuffer(data, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    n = int(data[:4].view("<u4")[0])
    low = MEMBER_BITS + 1 - n.bit_length()
    length = n + (1 << MEMBER_BITS - low)
    at = 4 + (length + 7) // 8
    value = (np.flatnonzero(np.unpackbits(data[4:at], count=length)) - np.arange(n)).astype(np.uint64) << np.uint64(low)
    for k in range(0, n, CHUNK):
        size = min(CHUNK, n - k)
        end = at + (size * low + 7) // 8
        bits = np.zeros((size, 64), np.uint8)
        bits[:, 64 - low :] = np.unpackbits(data[at:end], count=size * low).reshape(size, low)
        value[k : k + size] |= np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
        at = end
    return value


def _slot(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _keys(value: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as numbers whose order puts rare ones first."""
    return (levels[_slot(value)].astype(np.uint64) << np.uint64(56)) | (mix(value) >> np.uint64(8))


def prefix_length(size: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """How many of a set's first shingles must hold one that a partner has too."""
    return np.where(size > 0, size - (similarity * size + 99) // 100 + 1, 0)


# -- passes over the texts ----------------------------------------------------------------------


def _classes_and_sketches(docs: DataFrame, n: int) -> DataFrame:
    """A row per document (``doc_id, n_shingles, cls``) and, per task, the counts of its shingles by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "n_shingles", "cls", "chunk", "counts"]
        for batch in batches:
            for part in text_slices(batch):
                value, bounds = shingle_sets(part.column("text"), n)
                counts += np.bincount(_slot(value), minlength=len(counts)).astype(np.uint32)
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(set_classes(value, bounds)),
                     pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names
                )
        if counts.any():
            for k in range(len(counts) // CHUNK):
                own = np.minimum(counts[k * CHUNK : (k + 1) * CHUNK], 65535).astype("<u2")
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], names
                )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, cls bigint, chunk int, counts binary")


def _levels(sketches: DataFrame) -> np.ndarray:
    """One byte for each slot, larger for slots of more shingles: eight steps a doubling."""
    import pandas as pd

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.float64)
        for own in frame["counts"]:
            total += np.frombuffer(own, "<u2")
        level = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "levels": [level.tobytes()]})

    # 2 ** SKETCH_BITS bytes, whatever the input
    found = sketches.select("chunk", "counts").groupBy("chunk").applyInPandas(add, "chunk int, levels binary").collect()
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in found:
        levels[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.levels, np.uint8)
    return levels


def _prefixes(docs: DataFrame, levels, n: int, similarity: int) -> DataFrame:
    """``key, cls, n, rank, most``: the pivots in each class's window; a task gives each class once.

    ``most`` is the size of the largest partner that may share the key as its first: the two have no more in common than the shingles
    from the key on.
    ``rank`` is small for classes whose first shingles are common: an original has more of them than its
    altered copies, which makes it a good pivot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(levels.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for part in text_slices(batch):
                value, bounds = shingle_sets(part.column("text"), n)
                cls, size = set_classes(value, bounds), np.diff(bounds)
                fresh = np.zeros(len(cls), bool)
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh[i] = True
                owner = owners(bounds)
                keys, owner = _sorted_within(_keys(value, order), owner)
                place = np.arange(len(keys)) - bounds[owner]
                take = (place < prefix_length(size, similarity)[owner]) & fresh[owner]
                keys, owner, place = keys[take], owner[take], place[take]
                most = (size[owner] - place) * (100 + similarity) // similarity - size[owner]
                common = np.bincount(owner, (keys >> np.uint64(56)).astype(np.float64), len(size))
                taken = np.bincount(owner, minlength=len(size))
                rank = 255 - np.round(common / np.maximum(taken, 1)).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {"key": pa.array(keys.view(np.int64)), "cls": pa.array(cls[owner]), "n": pa.array(size[owner].astype(np.int32)),
                     "rank": pa.array(rank[owner].astype(np.int32)), "most": pa.array(most.astype(np.int32))}
                )

    return docs.mapInArrow(run, "key bigint, cls bigint, n int, rank int, most int")


def _place_in_filter(cls, doc_id):
    """Slot of a class and its document, the same for numpy and for Spark's integers."""
    return cls ^ doc_id ^ (doc_id << 13)


def _sets(docs: DataFrame, wanted, n: int) -> DataFrame:
    """``cls, members``: the whole sets, packed, of the documents that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            for part in text_slices(batch):
                value, bounds = shingle_sets(part.column("text"), n)
                cls = set_classes(value, bounds)
                doc_id = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                slot = _place_in_filter(cls, doc_id) & (FILTER_BITS - 1)
                chosen = np.flatnonzero((bits[slot >> 3] >> (slot & 7)) & 1).tolist()
                members = [packed_set(value[bounds[i] : bounds[i + 1]]) for i in chosen]
                yield pa.RecordBatch.from_pydict({"cls": pa.array(cls[chosen]), "members": pa.array(members, pa.binary())})

    return docs.mapInArrow(run, "cls bigint, members binary")


def _class_filter(classes: DataFrame) -> bytes:
    """``FILTER_BITS`` bits, of which those of the given classes (``cls``, and ``doc_id`` of one document) are set."""
    own = F.col("cls").bitwiseXOR(F.col("doc_id")).bitwiseXOR(F.shiftleft("doc_id", 13))
    slot = own.bitwiseAND(F.lit(FILTER_BITS - 1))
    # at most FILTER_BITS / 32768 rows of 4 KB
    rows = (
        classes.select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / 32768).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
        .collect()
    )
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:
        out[row.bucket * 4096 : (row.bucket + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


# -- regions ------------------------------------------------------------------------------------


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of classes ``a, b`` with ``common, n_a, n_b``, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, n_a, n_b = [], [], []
            for x, y in zip(batch.column("members_a"), batch.column("members_b")):
                u, v = unpacked_set(x.as_buffer()), unpacked_set(y.as_buffer())
                common.append(len(np.intersect1d(u, v, assume_unique=True)))
                n_a.append(len(u))
                n_b.append(len(v))
            kinds = {"common": common, "n_a": n_a, "n_b": n_b}
            yield pa.RecordBatch.from_pydict(
                {"a": batch.column("a"), "b": batch.column("b")} | {k: pa.array(v, pa.int64()) for k, v in kinds.items()}
            )

    of = lambda side: sets.select(F.col("cls").alias(side), F.col("members").alias(f"members_{side}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    found = met.select("a", "b", "members_a", "members_b").mapInArrow(
        run, "a bigint, b bigint, common bigint, n_a bigint, n_b bigint"
    )
    # a false alarm of the filter may have given a set twice
    return found.dropDuplicates(["a", "b"])


def _is_link(similarity: int):
    return 100 * F.col("common") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("common"))


def _size_fits(similarity: int):
    return 100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")


def _pairs(regions: DataFrame, similarity: int) -> DataFrame:
    """Pairs of members of a region (``region, cls, n, most, ball, seen``) that are not in one ball, where sizes, the place of the
    region's shingle and the distances to the region's pivots allow a link.

    The members outside the region's largest ball are dealt into blocks, and each block meets all members in a place of its own.
    """
    by_ball = regions.groupBy("region", "ball").agg(F.count(F.lit(1)).alias("size"))
    shape = by_ball.groupBy("region").agg(
        F.max(F.when(F.col("ball").isNotNull(), F.struct("size", "ball"))).alias("largest"), F.sum("size").alias("size")
    )
    others = F.col("size") - F.coalesce(F.col("largest.size"), F.lit(0))
    shape = shape.select(
        "region", F.col("largest.ball").alias("main"), F.greatest(F.lit(1), F.ceil(others / BLOCK)).cast("int").alias("blocks")
    )
    members = regions.join(shape, "region").withColumn("inside", F.coalesce(F.col("ball") == F.col("main"), F.lit(False)))
    left = members.where(~F.col("inside")).select(
        "region", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("x"), F.col("cls").alias("a"), F.col("n").alias("n_a"),
        F.col("most").alias("most_a"), F.col("ball").alias("ball_a"), F.col("seen").alias("seen_a"),
    )
    right = members.select(
        "region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.col("cls").alias("b"), F.col("n").alias("n_b"),
        F.col("most").alias("most_b"), F.col("ball").alias("ball_b"), F.col("seen").alias("seen_b"), "inside",
    )
    radius = 1 - similarity / 100
    apart = F.coalesce(F.col("ball_a") != F.col("ball_b"), F.lit(True))
    in_reach = F.forall(F.zip_with("seen_a", "seen_b", lambda u, v: F.abs(u - v) <= radius + 1e-6), lambda x: x)
    # where the region's shingle is the first that both have, they have no more in common than what follows it
    shares = (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b"))
    # two members outside the largest ball meet in both orders
    once = F.col("inside") | (F.col("a") < F.col("b"))
    met = left.join(right, ["region", "x"]).where(once).where(_size_fits(similarity)).where(shares).where(apart).where(in_reach)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_size(live: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Small regions (with more than one member, not all of one ball) and large ones, of at most ``most`` rows in all."""
    unlike = F.max(F.col("ball").isNull()) | (F.min("ball") != F.max("ball"))
    sizes = live.groupBy("key").agg(F.count(F.lit(1)).alias("size"), unlike.alias("open"))
    sized = stored_in_few(live.join(sizes.where("size > 1 AND open"), "key").drop("open"), "regions", most)
    small = sized.where(F.col("size") <= LEAF).drop("size")
    return small, sized.where(F.col("size") > LEAF).drop("size")


#: a region of more members, by the sketch, is not streamed through one task: about a million
HEAVY_LEVEL = 160

_MET = "key bigint, cls bigint, n int, rank int, most int, pivot bigint, n_pivot int"


def _first_pivots(windows: DataFrame, levels: np.ndarray) -> DataFrame:
    """``key, cls, n, rank, most, ball, seen, pivot, n_pivot, ball_pivot``: the members of each region but its first class, beside that class.

    First come members that may have a partner of their own size at least. A region without such members has no pairs.
    """
    none = F.lit(None).cast("int")
    if (levels < HEAVY_LEVEL).all():
        met = _streamed_pivots(windows)
    else:
        windows = stored(windows, "windows")
        level = F.shiftrightunsigned("key", 56)
        crowded = windows.where(level >= HEAVY_LEVEL).dropDuplicates(["key", "cls"])
        order = F.struct((F.col("most") < F.col("n")).alias("larger"), "rank", "cls", "n")
        first = crowded.groupBy("key").agg(F.min(order).alias("first")).where("NOT first.larger")
        first = stored_in_few(first, "first-pivots", windows.count())
        # rows of a key of any size meet one row, so they can be split
        found = crowded.join(first, "key").where(F.col("cls") != F.col("first.cls"))
        found = found.select("key", "cls", "n", "rank", "most", F.col("first.cls").alias("pivot"), F.col("first.n").alias("n_pivot"))
        met = _streamed_pivots(windows.where(level < HEAVY_LEVEL)).unionByName(found)
    return met.select("*", none.alias("ball"), F.array().cast("array<float>").alias("seen"), none.alias("ball_pivot"))


def _streamed_pivots(windows: DataFrame) -> DataFrame:
    """One pass over the windows sorted by region; a region is never held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cls, n, rank, most = (batch.column(c).to_numpy() for c in ("key", "cls", "n", "rank", "most"))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            again = np.zeros(len(key), bool)
            again[1:] = ~new[1:] & (cls[1:] == cls[:-1])
            if last is not None and last[0] == key[0]:
                new[0] = False
                again[0] = last[3] == cls[0]
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            begin = np.maximum(first, 0)
            pivot, size, useful = cls[begin], n[begin], most[begin] >= n[begin]
            if not new[0]:
                # the region began in an earlier batch
                goes_on = first < 0
                pivot, size = np.where(goes_on, last[1], pivot), np.where(goes_on, last[2], size).astype(np.int32)
                useful = np.where(goes_on, last[4], useful)
            last = (key[-1], pivot[-1], size[-1], cls[-1], useful[-1])
            keep = (cls != pivot) & ~again & useful
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array(key[keep]), "cls": pa.array(cls[keep]), "n": pa.array(n[keep]), "rank": pa.array(rank[keep]),
                 "most": pa.array(most[keep]), "pivot": pa.array(pivot[keep]), "n_pivot": pa.array(size[keep])}
            )

    lined = windows.repartition("key").sortWithinPartitions("key", F.col("most") < F.col("n"), "rank", "cls")
    return lined.mapInArrow(run, _MET)


def _pivots(live: DataFrame) -> DataFrame:
    """The same for regions that are left after a round; the pivot is the first member of no ball, else the first of all."""
    order = F.struct(F.col("ball").isNotNull().alias("taken"), "rank", "cls", "n", "ball")
    first = live.groupBy("key").agg(F.min(order).alias("first"))
    met = live.join(first, "key").where(F.col("cls") != F.col("first.cls"))
    return met.select(
        "key", "cls", "n", "rank", "most", "ball", "seen", F.col("first.cls").alias("pivot"), F.col("first.n").alias("n_pivot"),
        F.col("first.ball").alias("ball_pivot"),
    )


def _round(met: DataFrame, sets: DataFrame, similarity: int, number: int) -> tuple[DataFrame, DataFrame, int]:
    """Members beside a pivot of each region: the links found, what must still meet in each region, and the number of members.

    The ball is one component from now on, with all earlier balls it shares a member with: its members need not meet each
    other. ``ball`` is the number of the round that made it, null outside. A member within the radius stays only while a member of
    another ball, or of none, may be linked with it; a region that is one ball is done. ``seen`` keeps the distances to the
    pivots, up to twice the radius.
    """
    radius = 1 - similarity / 100
    # beyond twice the radius, which sizes alone may tell, the distance does not matter
    within = F.least("n", "n_pivot") >= (1 - 2 * radius) * F.greatest("n", "n_pivot") - 1e-9
    pairs = met.where(within).select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
    # neither the pairs nor the rows told nor what is left are more than the members
    most = met.count()
    measured = stored_in_few(_measured(pairs, sets), "distances", most)
    links = measured.where(_is_link(similarity)).select("a", "b")
    distance = 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    # only what is at most twice the radius away matters here, and it is little
    near = measured.select(
        F.col("a").alias("cls"), F.col("b").alias("pivot"), distance.alias("d"), _is_link(similarity).alias("linked")
    ).where(F.col("linked") | (F.col("d") <= 2 * radius + 1e-9))
    told = met.join(near, ["cls", "pivot"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    told = told.select("key", "cls", "n", "rank", "most", "ball", "seen", "ball_pivot", "d", "linked")
    told = stored_in_few(told, "told", most)
    # at most one row for each round so far and one for members of no ball
    by_ball = told.groupBy("key", "ball").agg(
        (F.max("linked") | F.coalesce(F.max("ball_pivot") == F.col("ball"), F.lit(False))).alias("joined"),
        F.count(F.when(~F.col("linked"), 1)).alias("outside"),
        F.min(F.when(~F.col("linked"), F.col("d"))).alias("edge"),
    )
    joined = F.col("joined") & F.col("ball").isNotNull()
    # the inner edge of what stays outside the ball
    regions = by_ball.groupBy("key").agg(
        F.collect_set(F.when(joined, F.col("ball"))).alias("joined"),
        F.max(~joined & (F.col("outside") > 0)).alias("open"),
        F.min(F.when(~joined, F.col("edge"))).alias("edge"),
    )
    needed = ~F.col("linked") | F.coalesce(F.col("d") >= F.col("edge") - radius - 1e-9, F.lit(False))
    rest = told.join(regions.where("open"), "key").where(needed)
    mine = F.col("linked") | F.coalesce(F.array_contains("joined", F.col("ball")), F.lit(False))
    far = F.lit(2 * radius)
    return links, rest.select(
        "key", "cls", "n", "rank", "most", F.when(mine, F.lit(number)).otherwise(F.col("ball")).alias("ball"),
        F.array_append("seen", F.least(F.coalesce("d", far), far).cast("float")).alias("seen"),
    ), most


def class_links(docs: DataFrame, rows: DataFrame, sketches: DataFrame, n: int, similarity: int) -> DataFrame:
    """Links ``a, b`` between classes that together connect what similarity connects."""
    spark: SparkSession = docs.sparkSession
    levels = _levels(sketches)
    held = spark.sparkContext.broadcast(levels.tobytes())
    size = F.col("n_shingles")
    windows = rows.agg(F.sum(size - F.ceil(similarity * size / 100) + 1).cast("bigint")).first()[0] or 0
    met = stored_in_few(_first_pivots(_prefixes(docs, held, n, similarity), levels), "met", windows)
    classes = met.select("cls").unionByName(met.select(F.col("pivot").alias("cls")))
    # one document stands for each class
    chosen = rows.groupBy("cls").agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("doc_id"))
    wanted = spark.sparkContext.broadcast(_class_filter(chosen.join(classes.distinct(), "cls", "left_semi")))
    sets = stored(_sets(docs, wanted, n), "sets")
    found, rest, most = _round(met, sets, similarity, 0)
    links, todo, measured = [found], [], most
    small, large = _by_size(rest, most)
    todo.append(small)
    for number in range(1, MOST_ROUNDS + 1):
        left = large.count()
        if not left:
            break
        found, rest, most = _round(stored_in_few(_pivots(large), "met", left), sets, similarity, number)
        links.append(found)
        measured += most
        small, large = _by_size(rest, most)
        todo.append(small)
    regions = [leaf.withColumn("region", F.struct(F.lit(number).alias("round"), "key")) for number, leaf in enumerate([*todo, large])]
    # of pairs no near bound is known
    every = stored_in_few(_pairs(reduce(DataFrame.unionByName, regions), similarity), "pairs")
    links.append(_measured(every, sets).where(_is_link(similarity)).select("a", "b"))
    return stored_in_few(reduce(DataFrame.unionByName, links).distinct(), "class-links", measured + every.count())


def jaccard_components(docs: DataFrame, n: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Two documents link when their distinct shingles of ``n`` lower-cased words have a Jaccard similarity of at least ``similarity`` percent.
    ``component_id`` is the smallest doc_id reachable by links. A null or empty text, or one of white space, has no
    shingles and links with nothing: its component is itself. A null doc_id is least of no component; a row alone with
    a null doc_id has a null component. Rows that repeat a doc_id are documents of their own. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = stored(_classes_and_sketches(texts, n), "classes")
    rows = both.where("chunk IS NULL").select("doc_id", "n_shingles", "cls")
    links = class_links(texts, rows, both.where("chunk IS NOT NULL"), n, similarity)
    grouped = components(links)
    # classes without links are their own component
    named = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    placed = named.join(grouped.withColumnRenamed("id", "cls"), "cls", "left")
    placed = placed.withColumn("component", F.coalesce("component_id", "cls"))
    least = placed.groupBy("component").agg(F.min("least").alias("first"))
    of_class = placed.join(least, "component").select("cls", F.col("first").alias("component_id"))
    with_set = rows.where("n_shingles > 0").join(of_class, "cls")
    without = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return with_set.select(*columns).unionByName(without.select(*columns))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest id stays, all columns as they were.

    Rows that repeat the doc_id that stays all stay.
    """
    kept = jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"))
    own = docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("bigint").alias("_id0"))
    return own.join(kept.distinct(), F.col("_id0").eqNullSafe(F.col("_id")), "left_semi").select("document.*")

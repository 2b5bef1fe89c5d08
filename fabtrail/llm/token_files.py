"""Token-id files compressed by a Re-Pair grammar, one grammar per shard.

Documents are encoded and written in ascending doc_id order. A shard holds whole documents up to about
``SHARD_IDS`` ids. Frequent id pairs are replaced by nonterminals, round after round; the shard keeps the rules, the number of ids
each rule expands to, and the remaining symbols. The expansion lengths say which symbols hold a span of ids, so a
single document is decoded without the rest.

Layout of a shard, all little-endian: magic ``RPG1``; counts of documents, rule rounds, rules, symbols
(uint32 each); lowest rule number (uint32); rules per round (uint32); rules (two uint32 each); expansion
lengths (uint32 each); doc ids (int64), a mask of null ids (uint8), ids per document (uint32); symbols (uint32).
Shards are rows of a Parquet table, so any store that Spark writes to can hold them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fabtrail.llm.words import text_slices, word_encoder
from fabtrail.session import scratch_path

MAGIC = b"RPG1"

#: ids after which a shard is closed; a longer document makes a longer shard
SHARD_IDS = 1 << 20

#: rounds of replacement, pairs replaced in one round, and how often a pair must occur
ROUNDS, PAIRS_PER_ROUND, LEAST_COUNT = 4, 4096, 8

#: bits of the table that finds a pair's rule
_TABLE_BITS = 18
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# -- the grammar --------------------------------------------------------------------------------


def _frequent_pairs(pairs: np.ndarray, most: int, least: int) -> np.ndarray:
    """Up to ``most`` distinct pairs that occur at least ``least`` times, most frequent first, ties by value."""
    ordered = np.sort(pairs)
    # places that begin ``least`` equal pairs: a pair has as many of them as it has occurrences beyond least - 1
    often = ordered[: max(len(ordered) - least + 1, 0)]
    often = often[often == ordered[least - 1 :]]
    first = np.flatnonzero(np.concatenate([[True], often[1:] != often[:-1]])[: len(often)])
    values, counts = often[first], np.diff(np.append(first, len(often)))
    return values[np.lexsort((values, -counts))[:most]]


def compress(ids: np.ndarray, rounds: int = ROUNDS, per_round: int = PAIRS_PER_ROUND, least: int = LEAST_COUNT):
    """``(symbols, rules, rules per round, lowest rule number)`` of an id sequence.

    In a round, of overlapping occurrences the first, third … of a run are replaced, so any set
    of pairs can be replaced at once.
    """
    seq = ids.astype(np.uint32)
    lowest = int(seq.max()) + 1 if len(seq) else 0
    top, rules, per = lowest, [], []
    for _ in range(rounds):
        if len(seq) < 2:
            break
        halves = np.empty((len(seq) - 1, 2), "<u4")
        halves[:, 1], halves[:, 0] = seq[:-1], seq[1:]
        pairs = halves.view("<u8").ravel()
        chosen = _frequent_pairs(pairs, per_round, least)
        if not len(chosen):
            break
        slot = lambda p: ((p * _GOLDEN) >> np.uint64(64 - _TABLE_BITS)).view(np.int64)
        # pairs that share a slot with a more frequent one wait for a later round
        _, keep = np.unique(slot(chosen), return_index=True)
        chosen = chosen[np.sort(keep)]
        taken = np.zeros(1 << _TABLE_BITS, bool)
        rule_of = np.zeros(1 << _TABLE_BITS, np.uint32)
        taken[slot(chosen)], rule_of[slot(chosen)] = True, np.arange(len(chosen))
        slots = slot(pairs)
        at = np.flatnonzero(taken[slots])
        rule = rule_of[slots[at]]
        own = chosen[rule] == pairs[at]
        at, rule = at[own], rule[own]
        starts_run = np.concatenate([[True], np.diff(at) > 1])
        run_start = at[starts_run][np.cumsum(starts_run) - 1]
        replaced = (at - run_start) & 1 == 0
        at = at[replaced]
        seq[at] = top + rule[replaced]
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq = seq[stays]
        rules.append(np.stack([(chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32)], 1))
        per.append(len(chosen))
        top += len(chosen)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), per, lowest


def expand(symbols: np.ndarray, rules: np.ndarray, per: list[int], lowest: int) -> np.ndarray:
    """The ids a run of symbols stands for."""
    top = lowest + len(rules)
    seq = symbols
    for n in reversed(per):
        top -= n
        is_rule = seq >= top
        width = is_rule.astype(np.int64) + 1
        at = (np.cumsum(width) - width)[is_rule]
        which = seq[is_rule] - lowest
        seq = np.repeat(seq, width)
        seq[at], seq[at + 1] = rules[which, 0], rules[which, 1]
    return seq


def expansion_lengths(rules: np.ndarray, per: list[int], lowest: int) -> np.ndarray:
    """Ids each rule expands to; rules refer to ids and to rules of earlier rounds only."""
    lengths = np.ones(len(rules), np.uint32)
    at = 0
    for n in per:
        sides = rules[at : at + n].astype(np.int64) - lowest
        known = np.where(sides >= 0, lengths[np.maximum(sides, 0)], 1)
        lengths[at : at + n] = known.sum(1)
        at += n
    return lengths


# -- one shard ----------------------------------------------------------------------------------


def pack_shard(doc_ids: np.ndarray, null_ids: np.ndarray, n_ids: np.ndarray, ids: np.ndarray) -> bytes:
    symbols, rules, per, lowest = compress(ids)
    head = np.array([len(doc_ids), len(per), len(rules), len(symbols), lowest, *per], "<u4")
    return b"".join(
        [
            MAGIC,
            head.tobytes(),
            rules.astype("<u4").tobytes(),
            expansion_lengths(rules, per, lowest).astype("<u4").tobytes(),
            doc_ids.astype("<i8").tobytes(),
            null_ids.astype("u1").tobytes(),
            n_ids.astype("<u4").tobytes(),
            symbols.astype("<u4").tobytes(),
        ]
    )


class Shard:
    """A shard read from its bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("these bytes are not a shard of token ids")
        at = 4

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        n_docs, n_rounds, n_rules, n_symbols, self.lowest = take("<u4", 5).tolist()
        self.per = take("<u4", n_rounds).tolist()
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.doc_ids = take("<i8", n_docs)
        self.null_ids = take("u1", n_docs).astype(bool)
        self.n_ids = take("<u4", n_docs)
        self.symbols = take("<u4", n_symbols)

    def all_ids(self) -> np.ndarray:
        return self._expanded(self.symbols)

    @cached_property
    def _of_rules(self) -> np.ndarray:
        """The ids of all rules, one rule after the other."""
        every = np.arange(self.lowest, self.lowest + len(self.rules))
        return expand(every, self.rules, self.per, self.lowest).astype(np.uint32)

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids a run of symbols stands for, taken from those of the rules."""
        table = np.concatenate([self._of_rules, symbols])
        sizes, sources = np.ones(len(symbols), np.int64), np.arange(len(self._of_rules), len(table))
        is_rule = symbols >= self.lowest
        which = symbols[is_rule] - self.lowest
        sizes[is_rule] = self.lengths[which]
        sources[is_rule] = (np.cumsum(self.lengths, dtype=np.int64) - self.lengths)[which]
        ends = np.cumsum(sizes)
        return table[np.repeat(sources - ends + sizes, sizes) + np.arange(int(sizes.sum()))]

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the shard; only the symbols that hold them are expanded."""
        if n == 0:
            return np.zeros(0, np.uint32)
        of_rule = np.maximum(self.symbols.astype(np.int64) - self.lowest, 0)
        known = self.lengths[of_rule] if len(self.lengths) else 1
        ends = np.cumsum(np.where(self.symbols >= self.lowest, known, 1), dtype=np.int64)
        first = int(np.searchsorted(ends, start, side="right"))
        last = int(np.searchsorted(ends, start + n, side="left"))
        before = int(ends[first - 1]) if first else 0
        part = self._expanded(self.symbols[first : last + 1])
        return part[start - before : start - before + n]

    def document(self, number: int) -> np.ndarray:
        """Ids of the shard's n-th document."""
        ends = np.cumsum(self.n_ids, dtype=np.int64)
        return self.span(int(ends[number] - self.n_ids[number]), int(self.n_ids[number]))


# -- Spark --------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode whole texts (null: empty), append ``end_id`` to each, and write the shards below ``path``.

    Documents are range-sorted by doc_id (null first; rows that repeat a doc_id by their text). A task keeps one
    slice of texts and one open shard in memory. An empty table gives a table without shards. Other columns are not read.
    """
    sorted_docs = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        no, kept, size = 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal no, kept, size
            doc_ids, nulls, n_ids, ids = (np.concatenate(x) for x in zip(*kept))
            payload = pack_shard(doc_ids, nulls, n_ids, ids)
            no, kept, size = no + 1, [], 0
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([no - 1], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int64()),
                 "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())}
            )

        for batch in batches:
            for part in text_slices(batch, limit=1 << 22):
                ids, bounds = encoder.encode(part.column("text"), end_id)
                own = part.column("doc_id")
                nulls = own.is_null().to_numpy(zero_copy_only=False)
                kept.append((own.fill_null(0).to_numpy(zero_copy_only=False), nulls, np.diff(bounds), ids))
                size += len(ids)
                if size >= shard_ids:
                    yield close()
        if kept:
            yield close()

    (
        sorted_docs.mapInArrow(shards, "shard int, n_docs bigint, n_ids bigint, payload binary")
        .withColumn("part", F.spark_partition_id())
        .write.option("compression", "zstd")
        .parquet(path)
    )


def shard_starts(files: DataFrame) -> DataFrame:
    """``part, shard, start``: the ids of all shards before, by a sum over partitions, then one inside each."""
    per_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per partition of the writer
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (
        files.select("part", "shard", "n_ids")
        .withColumn("_before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("part", "shard", (F.col("_part_start") + F.col("_before")).alias("start"))
    )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, no, payload in zip(batch.column("part").to_pylist(), batch.column("shard").to_pylist(), batch.column("payload")):
                shard = Shard(payload.as_py())
                ids = shard.all_ids().astype("<u4")
                ends = np.cumsum(shard.n_ids, dtype=np.int64)
                begins = ends - shard.n_ids
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                n = len(sums)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part] * n, pa.int32()), "shard": pa.array([no] * n, pa.int32()),
                     "doc_id": pa.array(shard.doc_ids, pa.int64(), mask=shard.null_ids), "place": pa.array(begins),
                     "n_tokens": pa.array(shard.n_ids.astype(np.int64)), "ids_crc32": pa.array(sums, pa.int64())}
                )

    files = spark.read.parquet(path)
    schema = "part int, shard int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint"
    # only the digests meet the starts: the shards' bytes are not shuffled
    told = files.select("part", "shard", "payload").mapInArrow(digests, schema)
    return told.join(shard_starts(files), ["part", "shard"]).select(
        "doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def document_ids(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the wanted doc_ids, decoding their spans only.

    The shards' lists of documents are scanned, the wanted ids met by a join, and each shard that holds any decodes just those.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, no, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "payload"))):
                shard = Shard(payload)
                n = len(shard.doc_ids)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([part] * n, pa.int32()), "shard": pa.array([no] * n, pa.int32()),
                     "number": pa.array(range(n), pa.int32()),
                     "doc_id": pa.array(shard.doc_ids, pa.int64(), mask=shard.null_ids)}
                )

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, numbers in zip(batch.column("payload").to_pylist(), batch.column("numbers").to_pylist()):
                shard = Shard(payload)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(shard.doc_ids[numbers], pa.int64(), mask=shard.null_ids[numbers]),
                     "ids": pa.array([shard.document(k).astype(np.int64) for k in numbers], pa.list_(pa.int64()))}
                )

    files = spark.read.parquet(path).select("part", "shard", "payload")
    places = files.mapInArrow(listed, "part int, shard int, number int, doc_id bigint")
    found = places.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    per_shard = found.groupBy("part", "shard").agg(F.sort_array(F.collect_list("number")).alias("numbers"))
    return files.join(per_shard, ["part", "shard"]).select("payload", "numbers").mapInArrow(
        decoded, "doc_id bigint, ids array<bigint>"
    )


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents' token files into the shared folder and digest what is read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return token_digests(spark, path)

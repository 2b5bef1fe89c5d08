"""Collocations by SON partitioning: phrases frequent somewhere, then counted everywhere.

Texts become shards: one language each, about ``SHARD_BYTES`` of text as a list of distinct words and their codes, stored once. A
phrase with ``SUPPORT`` occurrences in a language has, in some shard, at least the shard's share of them; so each shard is mined
completely at that local support, and what is frequent in any shard is a candidate. Shards hand their local counts on: where the
counts, together with the most that shards may have held back, do not reach the support, the phrase is dropped before it is counted
again. Words and pairs are mined first, then longer phrases whose pairs all are candidates.

The second pass counts all candidates in all shards. Which phrases are candidates is told by a Bloom filter of bounded size (more candidates
than it serves are false alarms, never losses); the counts are added up by the phrase's text, so they are exact. Scores, cuts and the
cover by longer phrases are joins of the counted phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fabtrail.llm.words import hash_words, mix, text_slices
from fabtrail.operators.ordering import lookup_join
from fabtrail.session import stored, stored_in_few

#: a phrase needs so many occurrences in its language
SUPPORT = 30

#: words of the longest phrase
LONGEST = 4

#: a phrase goes when a longer one around it has this many hundredths of its occurrences
COVER_PERCENT = 80

#: phrases reported for each language
TOP = 2000

#: text of one shard, about
SHARD_BYTES = 512 << 10

#: text a task holds for shards that are not full yet
HELD_BYTES = 16 << 20

#: keys that a task adds up before it hands them on
HELD_KEYS = 1 << 18

#: shards that are read and handed to Python at once
BATCH_SHARDS = 8

#: candidates that a task counts before it hands them on, with their texts (about 80 MB)
HELD_PHRASES = 1 << 20

#: languages whose local support is raised above one; the largest ones
RAISED_LANGS = 1000

#: bits of the candidates' filter: at least so many a candidate, 32 MB at most
BITS_PER_CANDIDATE = 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28

#: where a key's four bits in a word of the filter are taken from; the word's place lies between the first and the second
MARK_SHIFTS = 0, 46, 52, 58

#: fixed values: what ends a piece, and what parts its words
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_GAPS = b" \t"

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(WORD_GAPS)] = 1
_CLASS[list(PIECE_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)

SHARD_SCHEMA = "lang string, n_words bigint, words array<string>, codes binary"


def coded_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct lower-cased words of the texts, and the texts as codes with -1 between pieces."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    if offsets[0] == offsets[-1]:
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    own = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begins = np.zeros(len(own), bool)
    begins[(offsets[:-1] - offsets[0])[np.diff(offsets) > 0]] = True
    kind = _CLASS[own]
    inside = kind == 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | begins[1:]
    at = np.flatnonzero(starts)
    if not len(at):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    piece = np.cumsum((kind == 2) | begins)[at]
    ends = np.append(np.cumsum(inside)[at] - 1, np.count_nonzero(inside)).astype(np.int32)
    letters = _LOWER[own[inside]]
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes()))
    coded = words.dictionary_encode()
    breaks = np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    codes = np.full(len(at) + int(breaks[-1]), -1, np.int32)
    codes[np.arange(len(at)) + breaks] = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, codes


def shards_of(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """``lang, n_words, words, codes``: the texts of a task by language, in shards."""

    def shard(lang: str, texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        words, codes = coded_pieces(pa.concat_arrays(texts))
        if len(codes):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([int((codes >= 0).sum())]),
                 pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([codes.tobytes()], pa.binary())],
                ["lang", "n_words", "words", "codes"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for part in text_slices(batch, limit=shard_bytes):
                coded = part.column("lang").dictionary_encode()
                which = coded.indices.to_numpy(zero_copy_only=False)
                for k, lang in enumerate(coded.dictionary.to_pylist()):
                    texts = part.column("text").take(pa.array(np.flatnonzero(which == k)))
                    held.setdefault(lang, []).append(texts)
                    sizes[lang] = sizes.get(lang, 0) + texts.nbytes
                    if sizes[lang] >= shard_bytes:
                        yield from shard(lang, held.pop(lang))
                        del sizes[lang]
                if sum(sizes.values()) > HELD_BYTES:
                    for lang in list(held):
                        yield from shard(lang, held.pop(lang))
                    sizes.clear()
        for lang, texts in held.items():
            yield from shard(lang, texts)

    source = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return source.mapInArrow(run, SHARD_SCHEMA)


@contextmanager
def _few_shards_at_once(spark: SparkSession) -> Iterator[None]:
    """Readers and Python workers take ``BATCH_SHARDS`` rows at once: the usual thousands of rows would be all shards of a task."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(BATCH_SHARDS))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class _Bits:
    """A set of keys as a Bloom filter, all bits of a key in one word: false alarms occur, losses never."""

    def __init__(self, keys: DataFrame):
        """``keys`` has a column ``key`` of mixed 64-bit integers."""
        wanted = keys.count() * BITS_PER_CANDIDATE
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length() if wanted else 0))
        slot = F.col("key").bitwiseAND(F.lit(bits - 1))
        marks = keys.select(
            F.shiftright(slot, 6).alias("place"),
            F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(key, {k}) & 63L as int))" for k in MARK_SHIFTS)).alias("mark"),
        )
        found = marks.groupBy("place").agg(F.bit_or("mark").alias("mark")).toArrow()
        table = np.zeros(bits // 64, np.uint64)
        table[found["place"].to_numpy()] = found["mark"].to_numpy().view(np.uint64)
        self._last = np.uint64(bits - 1)
        self._table = keys.sparkSession.sparkContext.broadcast(table)

    def hold(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & self._last
        word = self._table.value[(slot >> np.uint64(6)).astype(np.int64)]
        held = np.ones(len(keys), bool)
        for k in MARK_SHIFTS:
            held &= (word >> ((keys >> np.uint64(k)) & np.uint64(63))) & np.uint64(1) == 1
        return held


def _phrase_keys(lang: str, words: pa.Array, codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: for each place a key of the phrase that begins there, and whether there is one."""
    own = mix(hash_words(words)[0] ^ hash_words(pa.array([lang + "\n"]))[0])
    each, met = own[codes], codes >= 0
    keys, there = mix(each + np.uint64(1)), met
    yield 1, keys, there
    for size in range(2, longest + 1):
        if len(keys) < 2:
            return
        keys = mix(keys[:-1] * _STEP + each[size - 1 :] + np.uint64(size))
        there = there[:-1] & met[size - 1 :]
        yield size, keys, there


def _of_row(batch: pa.RecordBatch, row: int) -> tuple[str, pa.Array, np.ndarray]:
    words = batch.column("words")
    bounds = words.offsets
    own = words.values.slice(bounds[row].as_py(), bounds[row + 1].as_py() - bounds[row].as_py())
    return batch.column("lang")[row].as_py(), pa.concat_arrays([own]), np.frombuffer(batch.column("codes")[row].as_py(), np.int32)


def locally_frequent(shards: DataFrame, shortest: int, longest: int, pairs: _Bits | None = None) -> DataFrame:
    """``key, extra, slack`` of the phrases that reach the local support of their shard (column ``least``).

    ``extra`` is the local count beyond what a shard may hold back, added up over some shards of a task; ``slack`` is what all
    shards of the language may hold back together. With ``pairs`` only phrases count whose pairs of neighbours are all in it.
    """

    def merged(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        keys, extra, slack = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(keys)
        keys, extra, slack = keys[order], extra[order], slack[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        columns = keys[first].view(np.int64), np.add.reduceat(extra, first), slack[first]
        for at in range(0, len(first), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], ["key", "extra", "slack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for row in range(batch.num_rows):
                lang, words, codes = _of_row(batch, row)
                least, slack = batch.column("least")[row].as_py(), batch.column("slack")[row].as_py()
                paired = None
                for size, keys, there in _phrase_keys(lang, words, codes, longest):
                    if pairs is not None and size == 2:
                        paired = there & pairs.hold(keys)
                    if size < shortest:
                        continue
                    if paired is not None:
                        there = there.copy()
                        for k in range(size - 1):
                            there &= paired[k : k + len(there)]
                    found, counts = np.unique(keys[there], return_counts=True)
                    kept = counts >= least
                    parts.append((found[kept], counts[kept] - (least - 1), np.full(kept.sum(), slack)))
                if sum(len(p[0]) for p in parts) >= HELD_KEYS:
                    yield from merged(parts)
                    parts = []
        if parts and sum(len(p[0]) for p in parts):
            yield from merged(parts)

    return shards.mapInArrow(run, "key bigint, extra bigint, slack bigint")


def _candidates(found: DataFrame, support: int) -> DataFrame:
    """Keys that may have the support: what was counted and what may have been held back."""
    sums = found.repartition("key").groupBy("key").agg(F.sum("extra").alias("extra"), F.max("slack").alias("slack"))
    return stored_in_few(sums.where(F.col("extra") + F.col("slack") >= support).select("key"), "candidates")


def candidate_counts(shards: DataFrame, candidates: _Bits, longest: int) -> DataFrame:
    """``lang, phrase, size, a``: occurrences of the candidates in some shards of a task."""

    class Held:
        def __init__(self):
            self.keys, self.counts, self.text_at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.texts: list[pa.Array] = []
            self.kinds: list[tuple[str, int]] = []  # language and size
            self.n_texts = 0

        def add(self, lang: str, words: pa.Array, codes: np.ndarray, size: int, keys: np.ndarray, places: np.ndarray) -> None:
            found, first, counts = np.unique(keys, return_index=True, return_counts=True)
            at = np.searchsorted(self.keys, found)
            known = np.zeros(len(found), bool)
            inner = at < len(self.keys)
            known[inner] = self.keys[at[inner]] == found[inner]
            self.counts[at[known]] += counts[known]
            if known.all():
                return
            new = ~known
            begin = places[first[new]]
            parts = [words.take(pa.array(codes[begin + k])) for k in range(size)]
            self.texts.append(pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0])
            self.kinds.append((lang, size))
            self.text_at = np.insert(self.text_at, at[new], self.n_texts + np.arange(len(begin)))
            self.counts = np.insert(self.counts, at[new], counts[new])
            self.keys = np.insert(self.keys, at[new], found[new])
            self.n_texts += len(begin)

        def rows(self) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(self.n_texts, np.int64)
            counts[self.text_at] = self.counts
            at = 0
            for texts, (lang, size) in zip(self.texts, self.kinds):
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, n), texts, pa.repeat(pa.scalar(size, pa.int32()), n), pa.array(counts[at : at + n])],
                    ["lang", "phrase", "size", "a"],
                )
                at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            for row in range(batch.num_rows):
                lang, words, codes = _of_row(batch, row)
                for size, keys, there in _phrase_keys(lang, words, codes, longest):
                    places = np.flatnonzero(there)
                    places = places[candidates.hold(keys[places])]
                    if len(places):
                        held.add(lang, words, codes, size, keys[places], places)
                if held.n_texts >= HELD_PHRASES:
                    yield from held.rows()
                    held = Held()
        yield from held.rows()

    # what a task adds up needs no shuffle: tasks take two parts of the scan where there are enough of them
    cores = shards.sparkSession.sparkContext.defaultParallelism
    few = shards.coalesce(max(2 * cores, shards.rdd.getNumPartitions() // 2))
    return few.mapInArrow(run, "lang string, phrase string, size int, a bigint")


def frequent_phrases(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, a`` of all phrases of 1 … ``longest`` words with the support, and ``lang, n`` of all languages' words."""
    shards = stored(shards_of(docs, shard_bytes), "shards")
    totals = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))
    # the least count that a shard must hand on: its share of the support, rounded up; one in languages beyond the largest
    raised = stored(totals.orderBy(F.desc("n"), "lang").limit(RAISED_LANGS), "languages")
    share = F.expr(f"cast((cast(n_words as decimal(38,0)) * {support} + n - 1) div n as bigint)")
    least = F.greatest(F.lit(1).cast("bigint"), share)
    local = shards.select("lang", "n_words").join(F.broadcast(raised), "lang").withColumn("least", least)
    slack = local.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("slack"))
    known = stored(raised.join(slack, "lang"), "languages")
    told = shards.join(F.broadcast(known), "lang", "left").select(
        "lang", "words", "codes",
        F.coalesce(least, F.lit(1)).alias("least"), F.coalesce("slack", F.lit(0)).cast("bigint").alias("slack"),
    )
    with _few_shards_at_once(docs.sparkSession):
        short = _candidates(locally_frequent(told, 1, 2), support)
    bits = short
    if longest > 2:
        pairs = _Bits(short)
        with _few_shards_at_once(docs.sparkSession):
            bits = short.unionByName(_candidates(locally_frequent(told, 3, longest, pairs), support))
    counted = candidate_counts(shards, _Bits(bits), longest)
    sums = counted.groupBy("lang", "phrase").agg(F.any_value("size").alias("size"), F.sum("a").alias("a"))
    with _few_shards_at_once(docs.sparkSession):
        return stored_in_few(sums.where(F.col("a") >= support), "phrases"), totals


def _lowest_cut(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, a, score, k, l, r`` of phrases of two words or more: the cut that scores lowest, of equal ones the first."""
    cuts = phrases.where("size >= 2").select(
        "lang", "phrase", "a",
        F.explode(F.expr("sequence(1, size - 1)")).alias("k"),
        F.split("phrase", " ").alias("words"),
    ).select(
        "lang", "phrase", "a", "k",
        F.expr("array_join(slice(words, 1, k), ' ')").alias("head"),
        F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("tail"),
    )
    for part, name in (("head", "l"), ("tail", "r")):
        known = phrases.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
        cuts = lookup_join(cuts, known, ["lang", part])
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (l + r) as bigint)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase").agg(F.any_value("a").alias("a"), best).select("lang", "phrase", "a", "best.*")


def _most_around(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, around``: for phrases inside longer ones, the most occurrences of such a longer one."""
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(words, i, n), ' '))))"
    )
    longer = phrases.where("size >= 3").withColumn("words", F.split("phrase", " "))
    return longer.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))


def collocations(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two words or more.

    Texts are lower-cased (A-Z) and cut into pieces and words; phrases lie within pieces, and overlapping occurrences count. A cut
    of a phrase scores 2,000,000 a / (l + r), rounded down, with the occurrences of the phrase and of both parts; the lowest cut
    counts. Phrases inside a longer one with 80 % of their occurrences go. Equal scores are ordered by occurrences, then by the
    phrase's bytes. A null lang counts as ``und``, a null text as empty; rows that repeat count each time; doc_id and other columns are not read.
    One very long text is a shard of its own. An empty table gives an empty result. Words are told apart by 64-bit hashes within a shard only.
    """
    phrases, totals = frequent_phrases(docs, support, longest, shard_bytes)
    scored = _lowest_cut(phrases).join(_most_around(phrases), ["lang", "phrase"], "left")
    kept = scored.where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * COVER_PERCENT))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] AS ws FROM d
), g AS (
  SELECT lang, k AS size, unnest([array_to_string(ws[i:i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]) AS phrase
  FROM (SELECT *, unnest(range(1, 5)) AS k FROM w) WHERE len(ws) >= k
), f AS (
  SELECT lang, phrase, any_value(size) AS size, count(*) AS a FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2 AND a >= 30
), parts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
), cuts AS (
  SELECT parts.lang, parts.phrase, parts.a, k, h.a AS l, t.a AS r, (2000000::HUGEINT * parts.a) // (h.a + t.a) AS score
  FROM parts JOIN f h ON h.lang = parts.lang AND h.phrase = head JOIN f t ON t.lang = parts.lang AND t.phrase = tail
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c))
), around AS (
  SELECT lang, phrase, max(a) AS around FROM inner_phrases GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * best.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

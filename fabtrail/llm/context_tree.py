"""Language-model scores by context-tree weighting over bytes.

A text is its UTF-8 bytes and one end mark. Each byte is eight binary decisions; for each of the 255 places
in that decision tree the ``DEPTH`` bytes before give a context tree. A node of it has a Krichevsky-Trofimov estimate from
its counts, and mixes it, weighted by how well each explains the training texts, with what its longer contexts say. So every
prediction mixes the estimates of all depths. A context not met in training hands on to nothing: the longest one met decides.

Counts of (context, byte) come from all training texts, merged in the tasks before they are shuffled, and lie together by the last two
bytes of the context, packed into one row for these. Longer contexts are weighted row by row; the sums for shorter ones are bounded by the
alphabet.
Each distinct (context, byte) gets its probability once. The most frequent ones, a fixed number, go to all tasks;
texts meet the rest by a join. The unigram base is computed in the same passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fabtrail.llm.quality import remainder
from fabtrail.llm.words import hash_words, owners, split_words, sums, text_slices
from fabtrail.session import stored

#: bytes of context; with the byte itself they fit into one 64-bit number
DEPTH = 6

#: the end mark, and what stands before a text's first byte: never part of UTF-8
END = 0xFF

#: entries that go to all tasks, at most: (context, byte) pairs and words
FREQUENT = {"gram": 1 << 21, "word": 1 << 20}

#: distinct entries a task merges before it hands them on, and how many it gathers between mergers
MERGED, GATHERED = 1 << 21, 1 << 20

#: entries that are weighed together, or as many as one suffix has
WEIGHED = 1 << 17

#: bytes of text that are counted or scored at once
SLICE = 1 << 19

#: remainders of word hashes by which words are dealt
WORD_BUCKETS = 1024

#: held-out documents: crc32 of the id has this remainder
FOLDS = 10

#: added to every count of the unigram base
ADDED = 0.1

HALF = np.log(0.5)


# -- inside a task ------------------------------------------------------------------------------


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with its context, the byte lowest, text after text; and their bounds."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    n = len(texts)
    start = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    own = np.frombuffer(raw, np.uint8)[start[0] : start[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    bounds = start - start[0] + np.arange(n + 1)
    out = np.full(len(own) + n, END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[bounds[1:] - 1] = False
    out[inner] = own
    place = np.arange(len(out)) - bounds[owners(bounds)]
    value = out.copy()
    for k in range(1, DEPTH + 1):
        before = np.full(len(out), END, np.uint64)
        before[k:] = out[: max(0, len(out) - k)]
        before[place < k] = END
        value |= before << np.uint64(8 * k)
    return value, bounds


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (63 bits) of the lower-cased words of each text, without the end; and their bounds."""
    words, bounds = split_words(texts, lower=True)
    return hash_words(words)[0] >> np.uint64(1), bounds


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


class _Counter:
    """Counts of numbers below 2 ** 63, with and without the held-out texts, merged as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.gathered = 0

    def add(self, values: np.ndarray, trained: np.ndarray) -> None:
        """A plain sort does: the lowest bit tells whether the text is learned from."""
        if len(values):
            marked = np.sort((values << np.uint64(1)) | trained.astype(np.uint64))
            values = marked >> np.uint64(1)
            first = _runs(values)
            total = np.diff(np.concatenate([first, [len(values)]]))
            learned = np.add.reduceat((marked & np.uint64(1)).astype(np.uint32), first)
            self.parts.append((values[first], total.astype(np.uint32), learned))
            self.gathered += len(first)

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All that was added: values in order, their counts, and those to learn from."""
        if len(self.parts) > 1:
            values, total, trained = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(values, kind="stable")
            values = values[order]
            first = _runs(values)
            counts = [np.add.reduceat(x[order], first, dtype=np.uint32) for x in (total, trained)]
            self.parts = [(values[first], *counts)]
        self.gathered = 0
        none = np.zeros(0, np.uint32)
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), none, none)


#: sorted entries of one bucket: differences of the keys, and counts
BUCKETS = "bucket int, keys binary, total binary, trained binary"


def _packed(kind: str, values: np.ndarray, total: np.ndarray, trained: np.ndarray, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted entries as rows of :data:`BUCKETS`, of up to ``most`` entries each.

    The bucket of a (context, byte) pair is the last ``SPLIT`` bytes of its context; buckets of words are negative.
    """
    if kind == "word":
        bucket = -1 - (values & np.uint64(WORD_BUCKETS - 1)).astype(np.int32)
    else:
        bucket = ((values >> np.uint64(8)) & _mask(SPLIT)).astype(np.int32)
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    bucket, values, total, trained = (x[order] for x in (bucket, values, total, trained))
    first = _runs(bucket)
    if most:
        first = np.union1d(first, np.arange(0, len(bucket), most))
    rows, size = [], 0
    for at, end in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
        keys = np.diff(values[at:end], prepend=np.uint64(0))
        rows.append((bucket[at], *(x.tobytes() for x in (keys, total[at:end].astype(np.int64), trained[at:end].astype(np.int64)))))
        size += end - at
        if size >= 1 << 17 or end == len(bucket):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.binary() if k else pa.int32()) for k, x in enumerate(zip(*rows))], ["bucket", "keys", "total", "trained"]
            )
            rows, size = [], 0


def _unpacked(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Kind, keys in order, total and trained counts of running buckets that have about ``enough`` entries; none is cut in two."""
    held, size, now = [], 0, 0

    def merged() -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        keys, total, trained = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = _runs(keys)
        return "word" if now < 0 else "gram", keys[first], *(np.add.reduceat(x[order], first) for x in (total, trained))

    for batch in batches:
        for bucket, keys, total, trained in zip(batch.column("bucket").to_pylist(), *(batch.column(c) for c in ("keys", "total", "trained"))):
            if held and bucket != now and (size >= enough or (bucket < 0) != (now < 0)):
                yield merged()
                held, size = [], 0
            # copies, so that what is held does not keep whole batches
            own = [np.frombuffer(x.as_buffer(), np.int64).copy() for x in (total, trained)]
            held.append((np.cumsum(np.frombuffer(keys.as_buffer(), np.uint64)), *own))
            size += len(own[0])
            now = bucket
    if held:
        yield merged()


def _counts(docs: DataFrame) -> DataFrame:
    """All (context, byte) pairs and words with their counts, one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {"gram": _Counter(), "word": _Counter()}

        def empty(kind: str) -> Iterator[pa.RecordBatch]:
            values, total, trained = counters[kind].merge()
            counters[kind] = _Counter()
            yield from _packed(kind, values, total, trained, 1 << 14)

        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                trained = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                for kind, find in (("gram", grams), ("word", text_words)):
                    values, bounds = find(part.column("text"))
                    counters[kind].add(values, trained[owners(bounds)])
                    if counters[kind].gathered > GATHERED and len(counters[kind].merge()[0]) > MERGED:
                        yield from empty(kind)
        for kind in counters:
            yield from empty(kind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in _unpacked(batches, GATHERED):
            yield from _packed(*entries)

    return docs.mapInArrow(run, BUCKETS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, BUCKETS)


# -- the tree -----------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series after eight steps up."""
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    half = log_gamma(np.array([0.5]))[0]
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - 2 * half - log_gamma(zeros + ones + 1.0)


class Level:
    """Nodes of one depth over sorted rows ``context * 256 + byte``.

    The rows that share a context and the first k bits of the byte lie together, so the nodes of each k are runs of rows.
    Rows may have count 0; a node without counts changes no other one. Only the given places ``bits`` of the byte are looked at.
    """

    def __init__(self, rows: np.ndarray, count: np.ndarray, bits: Iterable[int] = range(8)):
        self.rows, self.bits = rows, bits
        byte = (rows & np.uint64(255)).astype(np.int64)
        self.first, self.node, self.ones, self.total = {}, {}, {}, {}
        for k in bits:
            first = _runs(rows >> np.uint64(8 - k))
            node = np.zeros(len(rows), np.int32)
            node[first[1:]] = 1
            self.first[k], self.node[k] = first, np.cumsum(node, dtype=np.int32)
            if len(rows):
                self.total[k] = np.add.reduceat(count, first)
                self.ones[k] = np.add.reduceat(np.where((byte >> (7 - k)) & 1, count, 0.0), first)
            else:
                self.total[k] = self.ones[k] = np.zeros(0)
        self.stop: dict[int, np.ndarray] = {}
        self.log_weighted: dict[int, np.ndarray] = {}

    def weigh(self, deeper: Level | None, up: np.ndarray | None) -> None:
        """Mix with the level below, whose rows belong to this level's rows ``up``."""
        for k in self.bits:
            log_stop = log_kt(self.total[k] - self.ones[k], self.ones[k])
            if deeper is None:
                self.log_weighted[k], self.stop[k] = log_stop, np.ones(len(log_stop))
                continue
            parent = self.node[k][up[deeper.first[k]]]
            children = np.bincount(parent, deeper.log_weighted[k], len(log_stop))
            self.log_weighted[k] = np.logaddexp(HALF + log_stop, HALF + children)
            self.stop[k] = np.exp(HALF + log_stop - self.log_weighted[k])


def _mask(depth: int) -> np.uint64:
    return np.uint64((1 << 8 * depth) - 1)


#: depth whose contexts share a task; shallower ones are summed up
SPLIT = 2


def _rows(values: np.ndarray, trained: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """For the depths ``DEPTH`` to ``SPLIT``: rows, their counts, the row that each row of the level below belongs to, and each pair's."""
    rows, count, place = values, trained.astype(np.float64), np.arange(len(values), dtype=np.int32)
    out = {DEPTH: (rows, count, place, place)}
    for depth in range(DEPTH - 1, SPLIT - 1, -1):
        rows, up = np.unique(rows & _mask(depth + 1), return_inverse=True)
        up = up.astype(np.int32)
        count, place = np.bincount(up, count, len(rows)), up[place]
        out[depth] = (rows, count, up, place)
    return out


def _levels(rows: dict[int, tuple[np.ndarray, ...]], bits: Iterable[int]) -> dict[int, Level]:
    levels: dict[int, Level] = {}
    for depth, (own, count, up, _) in rows.items():
        levels[depth] = Level(own, count, bits)
        levels[depth].weigh(levels.get(depth + 1), up)
    return levels


def deep_levels(values: np.ndarray, trained: np.ndarray) -> tuple[dict[int, Level], dict[int, np.ndarray]]:
    """Levels ``SPLIT`` to ``DEPTH`` of distinct (context, byte) pairs in order, weighted from below, and for each level
    the row of every pair."""
    rows = _rows(values, trained)
    return _levels(rows, range(8)), {depth: place for depth, (*_, place) in rows.items()}


class Top:
    """What contexts of less than ``SPLIT`` bytes say, as three tables by last byte and place.

    ``said`` is the part of the probability of a one that they settle, ``left`` the weight that is left for longer
    contexts, and ``near`` the estimate of the longest one met, which takes that weight where no longer one was met.
    """

    def __init__(self, last: np.ndarray, place: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_weighted: np.ndarray):
        """From the sums of the level ``SPLIT`` by last byte and place."""
        shape = (256, 256)
        z, o, below = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        z[last, place], o[last, place], below[last, place] = zeros, ones, log_weighted
        met = z + o > 0
        stop1 = HALF + log_kt(z, o)
        weighted1 = np.logaddexp(stop1, HALF + below)
        z0, o0 = z.sum(0), o.sum(0)
        stop0 = HALF + log_kt(z0, o0)
        weighted0 = np.logaddexp(stop0, HALF + np.where(met, weighted1, 0).sum(0))
        share0, share1 = np.exp(stop0 - weighted0), np.exp(stop1 - weighted1)
        near0, near1 = (o0 + 0.5) / (z0 + o0 + 1), (o + 0.5) / (z + o + 1)
        self.said = np.where(met, share0 * near0 + (1 - share0) * share1 * near1, 0)
        self.left = np.where(met, (1 - share0) * (1 - share1), 1)
        self.near = np.where(met, near1, near0)


def log_probabilities(values: np.ndarray, trained: np.ndarray, top: Top) -> np.ndarray:
    """Natural logarithm of each byte's probability in its context; values are distinct and in order."""
    rows = _rows(values, trained)
    byte = (values & np.uint64(255)).astype(np.int64)
    last = ((values >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    out = np.zeros(len(values))
    # one place of the byte after the other, as levels of all of them take eight times as much memory
    for k in range(8):
        levels = _levels(rows, [k])
        place, bit = (byte | 256) >> (8 - k), (byte >> (7 - k)) & 1
        said, left, near = top.said[last, place], top.left[last, place], top.near[last, place]
        for depth in range(SPLIT, DEPTH + 1):
            level = levels[depth]
            node = level.node[k][rows[depth][3]]
            estimates = (level.ones[k] + 0.5) / (level.total[k] + 1)
            # a context that was not met hands on to nothing; neither do longer ones
            met = (level.total[k] > 0)[node]
            estimate, stop = estimates[node], level.stop[k][node]
            said = np.where(met, said + left * stop * estimate, said)
            left = np.where(met, left * (1 - stop), left)
            near = np.where(met, estimate, near)
        one = np.clip(said + left * near, 1e-12, 1 - 1e-12)
        out += np.log(np.where(bit == 1, one, 1 - one))
    return out


# -- a table that all tasks have ----------------------------------------------------------------


class Table:
    """Entries of distinct numbers below 2 ** 63 - 1, found by hashing; bulk look-ups only."""

    _NONE = np.uint64((1 << 64) - 1)
    _GOLDEN = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, entries: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, self._NONE, np.uint64)
        self.entries = np.zeros(1 << self.bits, entries.dtype)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == self._NONE
            # of several that want a slot one gets it
            chosen = np.zeros(len(keys), bool)
            chosen[np.flatnonzero(free)[np.unique(slot[free], return_index=True)[1]]] = True
            self.keys[slot[chosen]], self.entries[slot[chosen]] = keys[chosen], entries[chosen]
            keys, entries, slot = keys[~chosen], entries[~chosen], (slot[~chosen] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self._GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each value (0 where there is none), and whether there is one."""
        slot = self._slots(values)
        seen = self.keys[slot]
        met = seen == values
        out = np.where(met, self.entries[slot], 0)
        rest = np.flatnonzero(~met & (seen != self._NONE))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[rest]]
            hit = seen == values[rest]
            met[rest[hit]] = True
            out[rest[hit]] = self.entries[slot[rest[hit]]]
            rest = rest[~hit & (seen != self._NONE)]
        return out, met


# -- Spark --------------------------------------------------------------------------------------


def _learn_top(counted: DataFrame) -> Top:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, _, trained in _unpacked(batches, WEIGHED):
            rows = _rows(key, trained)
            for k in range(8):
                level = _levels(rows, [k])[SPLIT]
                own = level.rows[level.first[k]]
                last = ((own >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
                place = (((own & np.uint64(255)).astype(np.int64) | 256) >> (8 - k)).astype(np.int64)
                # sums by last byte and place
                nodes, up = np.unique(last << 8 | place, return_inverse=True)
                met = level.total[k] > 0
                columns = {"last": nodes >> 8, "place": nodes & 255}
                sums_of = {"zeros": level.total[k] - level.ones[k], "ones": level.ones[k], "below": np.where(met, level.log_weighted[k], 0)}
                columns |= {c: np.bincount(up, v, len(nodes)) for c, v in sums_of.items()}
                seen = columns["zeros"] + columns["ones"] > 0
                yield pa.RecordBatch.from_pydict({c: pa.array(v[seen]) for c, v in columns.items()})

    nodes = counted.where("bucket >= 0").mapInArrow(run, "last bigint, place bigint, zeros double, ones double, below double")
    # at most 256 * 255 rows
    rows = nodes.groupBy("last", "place").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toPandas()
    rows = rows.sort_values(["last", "place"])
    return Top(*(rows[c].to_numpy() for c in ("last", "place", "zeros", "ones", "below")))


def _weigh(counted: DataFrame, top) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, total, trained in _unpacked(batches, WEIGHED):
            value = log_probabilities(key, trained, top.value)
            key = key.view(np.int64)
            for at in range(0, len(key), 1 << 16):
                own = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_pydict(
                    {"key": pa.array(key[own]), "total": pa.array(total[own]), "value": pa.array(value[own])}
                )

    return counted.where("bucket >= 0").mapInArrow(run, "key bigint, total bigint, value double")


def _words(counted: DataFrame) -> DataFrame:
    """``key, total, trained`` of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, total, trained in _unpacked(batches, WEIGHED):
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "total": pa.array(total), "trained": pa.array(trained)})

    return counted.where("bucket < 0").mapInArrow(run, "key bigint, total bigint, trained bigint")


def _frequent(rows: DataFrame, most: int, column: str) -> Table:
    """A column of the rows with the largest ``total``, by their keys: at most ``most`` of them.

    The least total that counts is found from a histogram, by eighths of doublings.
    """
    step = F.floor(8 * F.log2(F.col("total").cast("double")))
    histogram = sorted(rows.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, n = None, 0
    for row in histogram:
        n += row.n
        if n > most:
            break
        least = row.step
    chosen = rows.where(step >= least) if least is not None else rows.where("false")
    table = chosen.select("key", column).toArrow()
    return Table(table.column("key").to_numpy().view(np.uint64), table.column(column).to_numpy())


def _lists(values: np.ndarray, keep: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The kept values of each text as a list."""
    places = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(values[keep].view(np.int64)))


def scores(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``.

    ``held_out`` documents (crc32 of the id as text mod 10 is 0) are not learned from. Tokens are the lower-cased words (A-Z only) and one end.
    ``base_score`` is the smoothed unigram log10 probability, ``score`` the model's log10 probability of the whole text and its end;
    ``bits_per_byte`` is the code length by it. A null text counts as empty: one token, the end. Rows that repeat a doc_id count each.
    Without training documents the model says one half of every bit. Other columns are not read. Words are told apart by 63-bit hashes.
    """
    spark = docs.sparkSession
    held = remainder(F.col("doc_id"), FOLDS) == 0
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    counted = stored(_counts(texts), "counts")
    words = _words(counted)
    top = spark.sparkContext.broadcast(_learn_top(counted))
    weighed = stored(_weigh(counted, top), "weighed")
    ends = texts.where("NOT held_out").count()
    known = words.agg(F.sum("trained").alias("n"), F.count(F.when(F.col("trained") > 0, 1)).alias("v")).first()
    n_train = (known.n or 0) + ends
    distinct = (known.v or 0) + (ends > 0)
    below = n_train + ADDED * (distinct + 1)
    frequent = spark.sparkContext.broadcast(
        [_frequent(weighed, FREQUENT["gram"], "value"), _frequent(words, FREQUENT["word"], "trained")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_table, word_table = frequent.value
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                values, bounds = grams(part.column("text"))
                log, met = gram_table.find(values)
                hashes, word_bounds = text_words(part.column("text"))
                count, word_met = word_table.find(hashes)
                base = np.where(word_met, np.log10((count + ADDED) / below), 0)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                     "n_words": pa.array(np.diff(word_bounds)), "n_bytes": pa.array(np.diff(bounds) - 1),
                     "known": pa.array(sums((count > 0).astype(np.int64), word_bounds)), "base": pa.array(sums(base, word_bounds)),
                     "log": pa.array(sums(log, bounds)), "words": _lists(hashes, ~word_met, word_bounds),
                     "grams": _lists(values, ~met, bounds)}
                )

    schema = (
        "doc_id bigint, held_out boolean, n_words bigint, n_bytes bigint, known bigint, base double, log double, "
        "words array<bigint>, grams array<bigint>"
    )
    told = stored(texts.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "texts")
    # what is not frequent is met by its key; sums per text are small again
    rare_words = told.select("row", F.explode("words").alias("key")).join(words, "key")
    word_log = F.log10((F.col("trained") + ADDED) / F.lit(float(below)))
    by_word = rare_words.groupBy("row").agg(
        F.sum(word_log).alias("more_base"), F.count(F.when(F.col("trained") > 0, 1)).alias("more_known")
    )
    by_gram = (
        told.select("row", F.explode("grams").alias("key")).join(weighed, "key").groupBy("row").agg(F.sum("value").alias("more_log"))
    )
    end_log = float(np.log10((ends + ADDED) / below))
    score = (F.col("log") + F.coalesce("more_log", F.lit(0.0))) / float(np.log(10))
    return (
        told.drop("words", "grams")
        .join(by_word, "row", "left")
        .join(by_gram, "row", "left")
        .select(
            "doc_id",
            "held_out",
            (F.col("n_words") + 1).alias("n_tokens"),
            (F.col("known") + F.coalesce("more_known", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
            F.lit(n_train).cast("bigint").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + end_log).alias("base_score"),
            score.alias("score"),
            "n_bytes",
            (-score * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
        )
    )

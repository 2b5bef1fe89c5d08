"""Text quality by a generalised additive model with pairwise interactions.

Every feature is a figure of the text alone. Each has a lookup table over its bins; some pairs of features
have a table over both. The tables are learned by cyclic boosting: in turn, each table is moved by a
shallow tree fitted to what all tables together still get wrong. A score is the sum of one entry a table, so a batch is
scored by indexing and adding.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from fabtrail.llm.words import owners, split_words, sums, text_slices

#: labelled rows the model is fitted to, at most: those with the smallest hashes of their ids
SAMPLE = 40_000

BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15

#: added to the weight of a leaf, so that few rows move little
SMOOTHING = 5.0

# -- features -----------------------------------------------------------------------------------

_SPACE, _LINE, _LOWER, _UPPER, _DIGIT, _STOP, _MARK, _BAR, _SYMBOL, _OTHER = range(10)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _SYMBOL, np.uint8)
    for name, kind in ((b" \t\v\f\r", _SPACE), (b"\n", _LINE), (b".,;:'\"-()", _STOP), (b"!?", _MARK), (b"|", _BAR)):
        table[list(name)] = kind
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    table[128:] = _OTHER
    return table


_CLASS = _byte_classes()

FEATURES = (
    "words", "word_length", "capitals", "digits", "stops", "marks", "bars", "symbols", "other_letters", "lines",
    "distinct_words", "top_word", "short_words", "long_words", "single_characters", "distinct_lines",
)


def features(texts: pa.Array) -> np.ndarray:
    """``(texts, features)`` figures of whole texts; an empty or null text has zeros."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    own = np.frombuffer(raw, np.uint8)[start[0] : start[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    cell = _CLASS[own] + np.repeat(np.arange(n, dtype=np.int64) * 10, sizes)
    per_class = np.bincount(cell, minlength=10 * n).reshape(n, 10).astype(np.float64)
    words, bounds = split_words(texts)
    count = np.diff(bounds).astype(np.float64)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.float64)
    owner = owners(bounds)
    coded = words.dictionary_encode()
    code = owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
    pair, times = np.unique(code, return_counts=True)
    of = pair // max(1, len(coded.dictionary))
    distinct = np.bincount(of, minlength=n).astype(np.float64)
    top = np.zeros(n)
    np.maximum.at(top, of, times)
    lines = pc.split_pattern(texts, "\n")
    line_owner = owners(lines.offsets.to_numpy(zero_copy_only=False).astype(np.int64) - lines.offsets[0].as_py())
    line_code = lines.flatten().dictionary_encode()
    lines_each = np.bincount(line_owner, minlength=n)
    unlike = np.unique(line_owner * max(1, len(line_code.dictionary)) + line_code.indices.to_numpy(zero_copy_only=False))
    lines_distinct = np.bincount(unlike // max(1, len(line_code.dictionary)), minlength=n)
    some, bytes_ = np.maximum(count, 1), np.maximum(sizes, 1)
    share = lambda mask: sums(mask.astype(np.float64), bounds) / some
    of_class = lambda k: per_class[:, k] / bytes_
    out = np.stack(
        [
            np.log1p(count), sums(length, bounds) / some, of_class(_UPPER), of_class(_DIGIT), of_class(_STOP),
            of_class(_MARK), of_class(_BAR), of_class(_SYMBOL), of_class(_OTHER), per_class[:, _LINE] / some,
            distinct / some, top / some, share(length <= 3), share(length >= 12), share(length == 1),
            lines_distinct / np.maximum(lines_each, 1),
        ],
        axis=1,
    )
    out[sizes == 0] = 0
    return out


# -- the model ----------------------------------------------------------------------------------


@dataclass
class Model:
    """Bin edges and tables; ``pairs`` are numbers of features with their coarse edges and table."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for a, b, table in self.pairs:
            total += table[
                np.searchsorted(self.coarse[a], x[:, a], side="right"),
                np.searchsorted(self.coarse[b], x[:, b], side="right"),
            ]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _best_cut(grad: np.ndarray, hess: np.ndarray) -> tuple[float, int]:
    """Gain and place of the cut of a row of bins that explains most; (0, 0) if none helps."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    all_g, all_h = grad.sum(), hess.sum()
    if not len(g):
        return 0.0, 0
    gain = g**2 / (h + SMOOTHING) + (all_g - g) ** 2 / (all_h - h + SMOOTHING) - all_g**2 / (all_h + SMOOTHING)
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int = 2) -> np.ndarray:
    """The step for each bin: leaves of a tree that cuts the row of bins up to ``depth`` times deep."""
    at = _best_cut(grad, hess)[1] if depth else 0
    if not at:
        return np.full(len(grad), grad.sum() / (hess.sum() + SMOOTHING))
    return np.concatenate([_tree(grad[:at], hess[:at], depth - 1), _tree(grad[at:], hess[at:], depth - 1)])


def _square_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of a tree that cuts one feature, then the other on both sides."""
    best = (0.0, np.zeros_like(grad))
    for turned in (False, True):
        g, h = (grad.T, hess.T) if turned else (grad, hess)
        at = _best_cut(g.sum(1), h.sum(1))[1]
        for cut in {at} if at else range(1, len(g)):
            gain, step = 0.0, np.zeros_like(g)
            for rows in (slice(0, cut), slice(cut, None)):
                own_gain, inner = _best_cut(g[rows].sum(0), h[rows].sum(0))
                gain += own_gain
                for cols in (slice(0, inner), slice(inner, None)) if inner else (slice(None),):
                    step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + SMOOTHING)
            if gain > best[0]:
                best = (gain, step.T if turned else step)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of one table after the other; y is 0 or 1.

    Without rows, or with one label only, the score is the labels' smoothed share (0.5 without rows).
    """
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    dims = x.shape[1]
    if not len(y) or y.min() == y.max():
        none = [np.zeros(0)] * dims
        return Model(base, none, [np.zeros(1)] * dims, [], none)
    edges = [_edges(x[:, k], BINS) for k in range(dims)]
    place = [np.searchsorted(edges[k], x[:, k], side="right") for k in range(dims)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    logit = np.full(len(y), base)

    def pull() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(dims):
            grad, hess = pull()
            step = RATE * _tree(np.bincount(place[k], grad, len(tables[k])), np.bincount(place[k], hess, len(tables[k])))
            tables[k] += step
            logit += step[place[k]]
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(dims)]
    rough = [np.searchsorted(coarse[k], x[:, k], side="right") for k in range(dims)]

    def sums_of(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        grad, hess = pull()
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = rough[a] * shape[1] + rough[b]
        return np.bincount(cell, grad, shape[0] * shape[1]).reshape(shape), np.bincount(cell, hess, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((-_square_tree(*sums_of(a, b))[0], a, b) for a in range(dims) for b in range(a)))[:PAIRS]
    pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for gain, a, b in ranked if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in pairs:
            step = RATE * _square_tree(*sums_of(a, b))[1]
            table += step
            logit += step[rough[a], rough[b]]
    return Model(base, edges, tables, pairs, coarse)


# -- Spark --------------------------------------------------------------------------------------


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("")).cast("binary")) % of


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to the labelled documents whose crc32 mod 3 is not 1, at most ``sample`` of them.

    Labels other than 0 and 1 are left out; of several labels of a document the mean decides, ties go to 1.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(remainder(F.col("doc_id"), 3) != 1)
    chosen = (
        usable.groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "quality": part.column("quality"),
                     "x": pa.array([row.tobytes() for row in x], pa.binary())}
                )

    # at most ``sample`` ids and labels go to each task, and as many rows of figures come back
    met = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = met.select("doc_id", "quality", "text").mapInArrow(figures, "doc_id bigint, quality int, x binary")
    # one row for each id, however often it is repeated
    rows = found.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("row")).select("doc_id", "row.*").toPandas()
    rows = rows.sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(rows["x"]), np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["quality"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    ``score`` (0 to 1) comes from the whole text only; null counts as empty, and an empty text is scored by its zeros. ``held_out``:
    the document's label is not learned from, whatever it is. Rows that repeat a doc_id are scored each. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(learn(docs, labels, sample)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        for batch in batches:
            for part in text_slices(batch):
                s = own.score(features(part.column("text")))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(s),
                     "predicted": pa.array((s >= 0.5).astype(np.int32))}
                )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text"
    )
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents with a score of at least 0.5, all columns as they were."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(learn(docs, labels, sample)))
    text_at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(text_at)], ["text"])
            at = 0
            for part in text_slices(texts):
                good = own.score(features(part.column("text"))) >= 0.5
                yield batch.slice(at, part.num_rows).filter(pa.array(good))
                at += part.num_rows

    return docs.mapInArrow(choose, docs.schema)

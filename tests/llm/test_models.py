import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from corpus import DOCUMENTS, documents, lower_words, sentence

from fabtrail.llm import context_tree, quality

SF = "/root/testdata/sf0.001"


def held(i, of, remainder):
    return zlib.crc32(("" if i is None else str(i)).encode()) % of == remainder


def test_base_scores_match_brute_force(spark, monkeypatch):
    rows = [r for r in DOCUMENTS if r[0] not in (14, None)]
    want = context_tree.scores(documents(spark, rows, clashing=True)).collect()
    counts = Counter()
    for i, t, _ in rows:
        if not held(i, 10, 0):
            counts.update([*lower_words(t), None])
    n, v = sum(counts.values()), len(counts)
    for r in want:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        tokens = [*lower_words(text), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert r.n_bytes == len((text or "").encode()) and r.score < 0
    # what is met by a join gives the same as what every task has
    monkeypatch.setattr(context_tree, "FREQUENT", {"gram": 100, "word": 5})
    again = {r.doc_id: r for r in context_tree.scores(documents(spark, rows)).collect()}
    for r in want:
        assert again[r.doc_id].score == pytest.approx(r.score) and again[r.doc_id].n_known == r.n_known
        assert again[r.doc_id].base_score == pytest.approx(r.base_score)


def _weighted(counts, context, place, depth):
    """Weighted probability, stop share and estimate of a node, straight from the definition."""
    zeros = sum(n for (c, b), n in counts.items() if c.endswith(context) and (b | 256) >> (8 - len(place)) == int("1" + place, 2) and not (b >> (7 - len(place))) & 1)
    ones = sum(n for (c, b), n in counts.items() if c.endswith(context) and (b | 256) >> (8 - len(place)) == int("1" + place, 2) and (b >> (7 - len(place))) & 1)
    kt = 1.0
    for k in range(zeros):
        kt *= (k + 0.5) / (k + 1)
    for k in range(ones):
        kt *= (k + 0.5) / (zeros + k + 1)
    if depth == context_tree.DEPTH:
        return kt, 1.0, zeros, ones
    below = 1.0
    for c in {c[len(c) - depth - 1 :] for (c, _) in counts if c.endswith(context)}:
        below *= _weighted(counts, c, place, depth + 1)[0]
    whole = (kt + below) / 2
    return whole, kt / 2 / whole, zeros, ones


def _probability(counts, context, byte):
    log = 0.0
    for k in range(8):
        place = format(byte, "08b")[:k]
        one, left, near = 0.0, 1.0, 0.5
        for depth in range(context_tree.DEPTH + 1):
            own = context[len(context) - depth :]
            _, stop, zeros, ones = _weighted(counts, own, place, depth)
            if not zeros + ones:
                break
            near = (ones + 0.5) / (zeros + ones + 1)
            one, left = one + left * stop * near, left * (1 - stop)
        one += left * near
        log += math.log(one if format(byte, "08b")[k] == "1" else 1 - one)
    return log


def test_probabilities_match_the_definition():
    texts = pa.array(["abab", "abba", "b"])
    values, _ = context_tree.grams(texts)
    keys, trained = np.unique(values, return_counts=True)
    keys = np.concatenate([keys, context_tree.grams(pa.array(["zab", "aaaaaaaa"]))[0]])
    keys, first = np.unique(keys, return_index=True)
    trained = np.where(first < len(trained), np.concatenate([trained, np.zeros(20, np.int64)])[np.minimum(first, len(trained) + 19)], 0)
    level = context_tree.deep_levels(keys, trained)[0][context_tree.SPLIT]
    sums = {}
    for k in range(8):
        for j, at in enumerate(level.first[k]):
            row = int(level.rows[at])
            own = sums.setdefault(((row >> 8) & 255, (row & 255 | 256) >> (8 - k)), [0.0, 0.0, 0.0])
            for x, v in enumerate((level.total[k][j] - level.ones[k][j], level.ones[k][j], level.log_weighted[k][j])):
                own[x] += v
    where = np.array(list(sums))
    top = context_tree.Top(where[:, 0], where[:, 1], *np.array(list(sums.values())).T)
    got = context_tree.log_probabilities(keys, trained, top)
    depth = context_tree.DEPTH
    split = lambda v: (int(v).to_bytes(8, "big")[7 - depth : 7], int(v) & 255)
    counts = {split(k): int(n) for k, n in zip(keys, trained) if n}
    for v, g in zip(keys, got):
        assert g == pytest.approx(_probability(counts, *split(v)), rel=1e-9)


def test_sixth_byte_of_a_context_counts():
    """What follows "bcdef" is told by the byte before it only."""
    values, _ = context_tree.grams(pa.array(["abcdefx", "zbcdefy"] * 20))
    keys, trained = np.unique(values, return_counts=True)
    zero = np.zeros(0, int)
    got = context_tree.log_probabilities(keys, trained, context_tree.Top(zero, zero, zero, zero, zero))
    seen = dict(zip(keys.tolist(), got))
    assert seen[int.from_bytes(b"abcdefx", "big")] > np.log(0.6) and seen[int.from_bytes(b"zbcdefy", "big")] > np.log(0.6)


def test_weighing_takes_bounded_memory_an_entry():
    import tracemalloc

    random = np.random.default_rng(6)
    keys = np.unique(random.integers(0, 1 << 56, 100_000).astype(np.uint64) & ~np.uint64(0xFFFF00) | np.uint64(0x616200))
    zero = np.zeros(0, int)
    top = context_tree.Top(zero, zero, zero, zero, zero)
    tracemalloc.start()
    context_tree.log_probabilities(keys, np.ones(len(keys), np.int64), top)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / len(keys) < 700


def test_counts_of_a_suffix_are_one_row(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "SLICE", 500)
    monkeypatch.setattr(context_tree, "MERGED", 50)
    monkeypatch.setattr(context_tree, "GATHERED", 50)
    texts = [(k, sentence(k, 60), k % 3 == 0) for k in range(20)] + [(20, None, False)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, held_out boolean").repartition(5)
    rows = context_tree._counts(frame).toArrow()
    assert rows.num_rows == len(set(rows.column("bucket").to_pylist()))
    got = {}
    for kind, *entries in context_tree._unpacked(rows.to_batches(), 100):
        for key, total, trained in zip(*(e.tolist() for e in entries)):
            assert (kind, key) not in got
            got[kind, key] = (total, trained)
    want = {}
    for _, text, held_out in texts:
        for kind, find in (("gram", context_tree.grams), ("word", context_tree.text_words)):
            for key in find(pa.array([text], pa.string()))[0].tolist():
                total, trained = want.get((kind, key), (0, 0))
                want[kind, key] = (total + 1, trained + (not held_out))
    assert got == want


def test_probabilities_sum_to_one():
    values, _ = context_tree.grams(pa.array([sentence(3, 50)]))
    keys, trained = np.unique(values, return_counts=True)
    context = keys[5] >> np.uint64(8)
    every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    all_keys = np.unique(np.concatenate([keys, every]))
    n = np.zeros(len(all_keys), np.int64)
    n[np.searchsorted(all_keys, keys)] = trained
    zero = np.zeros(0, int)
    top = context_tree.Top(zero, zero, zero, zero, zero)
    got = context_tree.log_probabilities(all_keys, n, top)
    assert np.exp(got[np.searchsorted(all_keys, every)]).sum() == pytest.approx(1)


def test_table_finds_what_it_holds():
    random = np.random.default_rng(4)
    for n in (0, 1, 5, 3000):
        keys = np.unique(random.integers(0, 1 << 62, n).astype(np.uint64))
        table = context_tree.Table(keys, np.arange(len(keys)) + 1.0)
        other = random.integers(0, 1 << 62, 500).astype(np.uint64)
        found, met = table.find(np.concatenate([keys, other, keys]))
        assert met[: len(keys)].all() and (found[: len(keys)] == np.arange(len(keys)) + 1).all()
        assert not met[len(keys) : len(keys) + 500].any() and (found[len(keys) + 500 :] == np.arange(len(keys)) + 1).all()


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 100.5, 1e6])
    assert np.allclose(context_tree.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_scores_of_nothing_and_of_held_out_only(spark):
    assert context_tree.scores(documents(spark, [])).collect() == []
    only = next(i for i in range(1000) if held(i, 10, 0))
    r = context_tree.scores(documents(spark, [(only, "ab c", "a")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)
    assert r.score == pytest.approx(8 * 5 * math.log10(0.5))


def test_held_out_texts_are_predicted_better_than_by_unigrams(spark):
    rows = context_tree.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in scored.collect())


@pytest.mark.parametrize("clashing", [False, True])
def test_quality_edge_cases(spark, clashing):
    docs = documents(spark, clashing=clashing)
    rows = [(i, i % 2, 0) for i in range(1, 14)] + [(5, None, 0), (None, 1, 0), (6, 9, 0), (8, 0, 0), (8, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(DOCUMENTS) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)
    none = quality.quality_scores(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(documents(spark, []), labels).collect() == []


def test_model_finds_an_interaction():
    random = np.random.default_rng(1)
    x = random.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    assert (0, 1) in {tuple(sorted(p[:2])) for p in model.pairs}


def test_features_ignore_neighbours():
    texts = ["Ab c.", None, "", "x|y!! 12\nx|y!! 12", "é é"]
    together = quality.features(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(together[k], quality.features(pa.array([t], pa.string()))[0])
    sliced = quality.features(pa.array(texts).slice(3))
    assert np.allclose(sliced, together[3:])

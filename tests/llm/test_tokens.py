import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpus import DOCUMENTS, documents, words
from tokenizers import Tokenizer

from fabtrail.llm import mixing, packing, token_files
from fabtrail.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
IDS = [(i, TOKENIZER.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in DOCUMENTS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("clashing", [False, True])
def test_token_files_round_trip(spark, clashing):
    got = token_files.token_file_digests(documents(spark, clashing=clashing), PATH).collect()
    want, start = [], 0
    texts = {i: t for i, t, _ in DOCUMENTS}
    for i, ids in sorted(IDS, key=lambda x: (x[0] is not None, x[0] or 0, texts[x[0]] or "")):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_single_documents_are_decoded(spark):
    path = scratch_path(spark, "test-tokens")
    token_files.write_token_files(documents(spark), path, PATH, 2, shard_ids=500)
    wanted = spark.createDataFrame([(3,), (9,), (15,), (99,)], "doc_id bigint")
    got = {r.doc_id: r.ids for r in token_files.document_ids(spark, path, wanted).collect()}
    assert got == {i: ids for i, ids in IDS if i in (3, 9, 15)}


def test_token_files_of_nothing(spark):
    assert token_files.token_file_digests(documents(spark, []), PATH).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    random = np.random.default_rng(seed)
    n = [0, 1, 2, 50, 5000, 60_000][seed]
    ids = (random.zipf(1.4, n) % 300).astype(np.uint32) if seed != 4 else np.full(n, 7, np.uint32)
    data = token_files.pack_shard(np.array([5]), np.array([False]), np.array([n]), ids)
    shard = token_files.Shard(data)
    assert np.array_equal(shard.all_ids(), ids)
    for a, b in ((0, n), (n // 3, n // 2), (n // 2, min(n, n // 2 + 1))):
        assert np.array_equal(shard.span(a, b - a), ids[a:b])
    if n > 1000:
        assert len(shard.symbols) < 0.8 * n


@pytest.mark.parametrize("clashing", [False, True])
def test_pack_covers_every_id_once(spark, clashing):
    rows = packing.pack(documents(spark, clashing=clashing), PATH).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, ids in IDS:
        own = sorted(by_doc[i], key=lambda r: r.start)
        copies = sum(1 for j, _ in IDS if j == i)
        assert sum(r.length for r in own) == copies * len(ids)
        assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and r.doc_tokens == len(ids) for r in own)
        starts = sorted({(r.start, r.length) for r in own})
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:]))
        assert own[-1].offset + own[-1].length <= packing.CAPACITY
    assert len(by_sequence) <= sum(len(ids) for _, ids in IDS) / packing.CAPACITY * 1.05 + 1


def test_pack_nothing(spark):
    assert packing.pack(documents(spark, []), PATH).collect() == []


@pytest.mark.parametrize("capacity", [64, 4096])
def test_cut_lengths(capacity):
    for n in list(range(1, 300)) + [capacity - 1, capacity, capacity + 1, 3 * capacity + 77]:
        pieces = packing.cut(n, capacity)
        assert sum(pieces) == n and all(0 < p <= capacity for p in pieces)


def test_mix_follows_the_weights(spark):
    rows = {r.doc_id: r for r in mixing.mix(documents(spark, clashing=True)).where("doc_id IS NOT NULL").collect()}
    again = {r.doc_id: r for r in mixing.mix(documents(spark)).where("doc_id IS NOT NULL").collect()}
    assert {k: r.taken for k, r in rows.items()} == {k: r.taken for k, r in again.items()}
    sizes = defaultdict(int)
    for _, t, s in DOCUMENTS:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in sizes if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    target |= {s: 3 * sizes[s] for s in full}
    taken = defaultdict(int)
    for r in mixing.mix(documents(spark)).collect():
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


def test_mix_nothing_and_wordless(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    rows = mixing.mix(documents(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 2


def test_mixed_documents_are_whole(spark):
    docs = documents(spark, clashing=True)
    left = mixing.mixed_documents(docs)
    assert left.columns == docs.columns
    texts = {i: t for i, t, _ in DOCUMENTS}
    rows = left.collect()
    assert rows and all(r.text == texts[r.doc_id] for r in rows)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 3000])
def test_frequent_pairs_are_those_of_a_count(n):
    pairs = np.random.default_rng(n).integers(0, 40, n).astype(np.uint64) ** np.uint64(3)
    for least in (1, 2, 8, 70):
        for most in (3, 100):
            counts = defaultdict(int)
            for p in pairs.tolist():
                counts[p] += 1
            want = sorted((p for p in counts if counts[p] >= least), key=lambda p: (-counts[p], p))[:most]
            assert token_files._frequent_pairs(pairs, most, least).tolist() == want


def test_rules_are_expanded_once_for_all_documents(monkeypatch):
    ids = (np.random.default_rng(3).zipf(1.4, 20_000) % 300).astype(np.uint32)
    shard = token_files.Shard(token_files.pack_shard(np.arange(200), np.zeros(200, bool), np.full(200, 100), ids))
    calls, whole = [], token_files.expand
    monkeypatch.setattr(token_files, "expand", lambda *a: calls.append(len(a[0])) or whole(*a))
    got = [shard.document(k) for k in range(200)]
    assert np.array_equal(np.concatenate(got), ids) and np.array_equal(shard.all_ids(), ids)
    # only the rules go through their rounds, not the symbols
    assert calls == [len(shard.rules)]

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import DOCUMENTS, SPACES, documents, lower_words, sentence

from fabtrail import session
from fabtrail.llm import exact_dedup, graph, jaccard_join


@pytest.mark.parametrize("clashing", [False, True])
def test_exact_groups_match_brute_force(spark, clashing):
    got = [tuple(r) for r in exact_dedup.exact_groups(documents(spark, clashing=clashing)).collect()]
    norm = [(i, SPACES.sub(" ", t or "")) for i, t, _ in DOCUMENTS]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want = Counter()
    for i, t in norm:
        own = groups[t]
        keep = min((x for x in own if x is not None), default=None)
        want[(i, keep, len(own), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r[0], r[1], r[2], r[4]) for r in got) == want
    kept = Counter(r[4] for r in got if r[3])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r[0] == r[1] for r in got if r[3])


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).collect() == []


def test_drop_repeats_keeps_columns(spark):
    docs = documents(spark, clashing=True)
    left = exact_dedup.drop_repeats(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    # 2 equals 1, 4 equals 3, the second row of 14 goes
    assert ids == Counter([1, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, None])


def test_many_false_alarms_change_nothing(spark):
    rows = [(k, f"text {k % 40}", "a") for k in range(100)]
    docs = documents(spark, rows)
    want = {(k, k % 40) for k in range(100)}
    digests = docs.selectExpr("doc_id", "sha2(text, 256) AS text_sha256")
    flagged = exact_dedup.possibly_repeated(digests, 1 << 15).collect()
    assert all(r.again for r in flagged)
    crowded = exact_dedup.possibly_repeated(digests.where("doc_id < 40"), 16).collect()
    assert sum(r.again for r in crowded) > 0
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(docs).collect()} == want


def _components(sets, similarity):
    ids = list(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= similarity * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in ids}


def _sets(rows, n=5):
    out = {}
    for i, t, _ in rows:
        w = lower_words(t)
        if len(w) >= n:
            out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        else:
            out[i] = frozenset([tuple(w)]) if w else frozenset()
    return out


@pytest.mark.parametrize("clashing", [False, True])
def test_jaccard_components_match_brute_force(spark, clashing):
    got = jaccard_join.jaccard_components(documents(spark, clashing=clashing)).collect()
    rows = [(i if i is not None else 10**9, t, s) for i, t, s in DOCUMENTS]
    sets = _sets(rows)
    want = _components(sets, 80)
    assert len(got) == len(DOCUMENTS)
    for r in got:
        key = 10**9 if r.doc_id is None else r.doc_id
        assert r.n_shingles == len(sets[key])
        assert r.component_id == (None if r.doc_id is None else want[key])


def test_jaccard_rounds_and_blocks_lose_no_link(spark, monkeypatch):
    """Large regions: chains of near copies, and a passage that unlike texts share."""
    monkeypatch.setattr(jaccard_join, "LEAF", 3)
    monkeypatch.setattr(jaccard_join, "MOST_ROUNDS", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    base = sentence(3, 90).split()
    rows = []
    for k in range(60):
        # each differs from its neighbours a little, from far ones a lot
        own = base[:]
        own[: k // 2] = [f"x{j}" for j in range(k // 2)]
        rows.append((k, " ".join(own + [f"end{k % 2}"]), "a"))
    passage = sentence(77, 40)
    rows += [(100 + k, passage + f" other{k} " + sentence(200 + k, 6), "b") for k in range(40)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()}
    assert got == _components(_sets(rows), 80)


def test_jaccard_link_between_two_families(spark):
    """Versions of two texts, connected by one link between two that are in the balls of unlike pivots."""
    shared = [f"shared{j}" for j in range(204)]
    own = lambda name, n: [f"{name}{j}" for j in range(n)]
    rows = [(k, [f"left{k}", *shared[17:], *own("end", 5)], "a") for k in range(24)]
    rows += [(100 + k, [*own("begin", 5), *shared[:-17], f"right{k}"], "a") for k in range(24)]
    # so that the parts that only one family has are not the rare ones
    rows += [(200 + k, [*shared[:21], *own(f"other{k}x", 150), *shared[-21:]], "a") for k in range(60)]
    rows += [(300, [*own("new", 20), *shared, *own("end", 5)], "a"), (301, [*own("begin", 5), *shared, *own("late", 20)], "a")]
    rows = [(i, " ".join(words), source) for i, words, source in rows]
    want = _components(_sets(rows), 80)
    assert want[100] == want[300] == want[301] == 0
    assert _components(_sets(rows[:-1]), 80)[100] == 100 and _components(_sets(rows[:-2] + rows[-1:]), 80)[100] == 100
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("heavy", [160, 0])
def test_jaccard_of_texts_that_share_a_passage(spark, monkeypatch, heavy):
    monkeypatch.setattr(jaccard_join, "HEAVY_LEVEL", heavy)
    passage = sentence(77, 60)
    rows = [(k, f"{sentence(300 + k, 3 + 4 * (k % 25))} {passage}", "a") for k in range(60)]
    rows += [(100 + k, f"{passage} {' '.join(sentence(400, 14).split()[: k % 15])}", "b") for k in range(40)]
    rows += [(200 + k, f"{passage} {sentence(500, 90)} {sentence(600 + k, k % 30)}", "c") for k in range(40)]
    want = _components(_sets(rows), 80)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()}
    assert got == want


def test_jaccard_of_nothing(spark):
    assert jaccard_join.jaccard_components(documents(spark, [])).collect() == []
    assert jaccard_join.drop_near_copies(documents(spark, [])).collect() == []


def test_drop_near_copies(spark):
    docs = documents(spark, [r for r in DOCUMENTS if r[0] is not None], clashing=True)
    left = jaccard_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 3, 4, 5, 6, 8, 10, 13, 14, 14, 15])


def test_few_rows_in_many_partitions_are_stored_in_few_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    monkeypatch.setattr(jaccard_join, "LEAF", 3)
    base = sentence(3, 90).split()
    rows = [(k, " ".join([f"x{j}" for j in range(k // 2)] + base[k // 2 :] + [f"end{k % 2}"]), "a") for k in range(60)]
    rows += [(100 + k, sentence(77, 40) + f" other{k} " + sentence(200 + k, 6), "b") for k in range(40)]
    rows += [(200 + k, t, s) for k, t, s in rows]
    many = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in many}
    for key, value in many.items():
        spark.conf.set(key, value)
    try:
        docs = documents(spark, rows)
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
        kept = {r.doc_id for r in exact_dedup.drop_repeats(docs).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == _components(_sets(rows), 80)
    assert kept == {k for k, _, _ in rows if k < 200}
    for table in ("met", "distances", "told", "regions", "pairs", "class-links", "links", "groups"):
        folders = list(tmp_path.glob(f"shared/fabtrail/*/{table}-*"))
        assert folders
        for folder in folders:
            assert len(list(folder.glob("part-*"))) <= spark.sparkContext.defaultParallelism


def test_components_of_a_path_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(0, 40)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (2000, 2000)]
    got = {r.id: r.component_id for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{1000 + k: 1000 for k in range(50)}}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 255, 256, 1000, 65536, 70001, 200003])
def test_packed_sets_lose_nothing(n):
    from fabtrail.llm.jaccard_join import packed_set, unpacked_set

    value = np.sort(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
    if n > 2:
        value[0], value[-1] = 0, (1 << 64) - 1
        value[1] = value[2]
    data = packed_set(value)
    assert unpacked_set(data).tolist() == (value >> np.uint64(24)).tolist()
    assert n < 64 or len(data) < 0.92 * 5 * n

"""Centroid clusters, collocations and nearest vectors against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import LONG, LOWER

from pyspark.sql import functions as F

from fabtrail import session
from fabtrail.llm import centroids, collocations, nearest

# -- centroid clustering ------------------------------------------------------------------------


def vectors(spark, rows, kind="float"):
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    return frame.select("*", *[F.lit(k).alias(c) for k, c in enumerate(["cluster", "distance", "vector", "n", "row", "score"])])


def brute_clusters(rows, dims, k, rounds, scale=1024):
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    sha = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    cents = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for n in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == n]
            if mine:
                cents[n] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign() if cents else []
    total, by = sum(d for d, _ in own), Counter()
    for d, c in own:
        by[c] += d
    most = (1 << 63) - 1
    return [
        (i, c, min(d, most), min(by[c], most), min(total, most), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, own)
    ]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_clusters_match_brute_force(spark):
    random = np.random.default_rng(5)
    middles = random.standard_normal((5, 6))
    rows = [(k, [float(x) for x in np.float32(middles[k % 5] + 0.3 * random.standard_normal(6))]) for k in range(200)]
    rows += [(300 + k, rows[0][1]) for k in range(30)] + [(7, rows[7][1]), (None, rows[9][1])]
    rows += [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0] * 5 + [None]), (404, [float("nan")] * 6), (405, [float("inf")] * 6), (406, [1.0] * 7)]
    for k, rounds in ((8, 10), (1, 3), (40, 4)):
        got = centroids.centroid_clusters(vectors(spark, rows), clusters=k, rounds=rounds, dims=6).collect()
        same(got, brute_clusters(rows, 6, k, rounds))


def test_ties_and_empty_centroids(spark):
    # vectors halfway between centroids, and equal first centroids of which one stays empty
    rows = [(k, [float(k % 4), 0.0]) for k in range(24)] + [(100 + k, [1.5, 0.0]) for k in range(5)]
    got = centroids.centroid_clusters(vectors(spark, rows), clusters=6, rounds=3, dims=2, scale=2).collect()
    same(got, brute_clusters(rows, 2, 6, 3, scale=2))


def test_huge_components_are_counted_exactly(spark):
    rows = [(k, [s * 3e38, 1.0 + k, -2e30]) for k, s in enumerate([1, -1, 0, 1, 0.5])] + [(9, [0.5, 0.25, 0.125])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = centroids.centroid_clusters(vectors(spark, rows), clusters=3, rounds=4, dims=3).collect()
    same(got, brute_clusters(rows, 3, 3, 4))


def test_orchard_measures_fewer_than_all():
    random = np.random.default_rng(2)
    middles = random.integers(-(10**5), 10**5, (40, 8))
    x = middles[random.integers(0, 40, 2000)] + random.integers(-500, 500, (2000, 8))
    which, distance, measured = centroids.Neighbours(middles.tolist()).nearest(x)
    all_distances = ((x[:, None] - middles[None]) ** 2).sum(axis=2)
    assert (which == all_distances.argmin(axis=1)).all() and (distance == all_distances.min(axis=1)).all()
    assert measured < 0.7 * all_distances.size


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        assert centroids.centroid_clusters(vectors(spark, rows)).collect() == []
    one = centroids.centroid_clusters(vectors(spark, [(4, [0.5] * 64)])).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in one] == [(4, 0, 0, 0)]


# -- collocations -------------------------------------------------------------------------------


def brute_collocations(rows, support, longest, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) >= 2 and a >= support}
        scored = []
        for p, a in cands.items():
            if any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in cands.items()
            ):
                continue
            score, _, left, right = min(
                (2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))
            )
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def texts(spark, rows):
    frame = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(rows)], "doc_id bigint, text string, lang string")
    return frame.select("*", *[F.lit(1).alias(c) for c in ["phrase", "key", "n", "a", "l", "r", "words", "codes"]])


TEXTS = (
    [("New York is big, new york IS old. The New York Times!", "en"), ("der hund;der Hund bellt laut\nder hund", "de")] * 20
    + [("a b a b a b a", "en"), ("a b é é É é", None), ("x.y.z", "en"), (None, "de"), ("", None), (" \t\r\n", "xx"), ("one", None)] * 5
    + [("the quick brown fox jumps over the lazy dog " * 3, "en"), ("the quick red fox", "en")] * 4
)


@pytest.mark.parametrize("shard", [1, 60, 1 << 19])
@pytest.mark.parametrize("held", [1, 1 << 18])
def test_collocations_match_brute_force(spark, monkeypatch, shard, held):
    monkeypatch.setattr(collocations, "HELD_PHRASES", held)
    monkeypatch.setattr(collocations, "HELD_KEYS", held)
    frame = texts(spark, TEXTS).repartition(5)
    got = collocations.collocations(frame, support=6, top=7, shard_bytes=shard).collect()
    same(got, brute_collocations(TEXTS, 6, 4, 7))


def test_collocations_beyond_the_bitmap_and_the_known_languages(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    monkeypatch.setattr(collocations, "RAISED_LANGS", 1)
    got = collocations.collocations(texts(spark, TEXTS), support=6, top=50, shard_bytes=200).collect()
    same(got, brute_collocations(TEXTS, 6, 4, 50))


def test_collocations_of_nothing_and_of_long_texts(spark):
    assert collocations.collocations(texts(spark, [])).collect() == []
    assert collocations.collocations(texts(spark, [(None, None), ("a b", "en")])).collect() == []
    rows = [(LONG, "en"), (LONG, "en")]
    got = collocations.collocations(texts(spark, rows), support=40, top=30, shard_bytes=1000).collect()
    same(got, brute_collocations(rows, 40, 4, 30))


def test_pieces_are_cut_as_written():
    import pyarrow as pa

    words, codes = collocations.coded_pieces(pa.array(["A b", "b. é", None, "", "..", "c"]))
    shown = ["|" if c < 0 else words[int(c)].as_py() for c in codes]
    assert shown == ["a", "b", "|", "b", "|", "é", "|", "c"]


# -- nearest vectors ----------------------------------------------------------------------------


def brute_nearest(rows, k=20, every=20):
    usable = [
        (i, n, v) for n, (i, v) in enumerate(rows)
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = []
    for i, n, q in usable:
        if i % every == 0:
            scores = []
            for j, m, c in usable:
                if m != n and len(c) == len(q):
                    s = 0.0
                    for x, y in zip(q, c):
                        s += x * y
                    scores.append((-s, j))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("group, slab, sample", [(1 << 16, 1 << 11, 1024), (7, 50, 30), (3, 1000, 0)])
def test_nearest_match_brute_force(spark, monkeypatch, group, slab, sample):
    monkeypatch.setattr(nearest, "SAMPLE", sample or 1)
    monkeypatch.setattr(nearest, "MOST_SLAB", slab)
    monkeypatch.setattr(nearest, "BLOCK", 33)
    random = np.random.default_rng(8)
    middles = random.standard_normal((6, 16))
    rows = [(3 * k - 90, [float(x) for x in np.float32(middles[k % 6] + 0.2 * random.standard_normal(16))]) for k in range(400)]
    # copies, ties, other lengths, scaled vectors, and what takes no part
    rows += [(5000 + k, rows[3][1]) for k in range(70)] + [(20, rows[5][1]), (20, rows[5][1])]
    rows += [(6000 + k, [float(k % 3), 1.0]) for k in range(50)] + [(7000, [1.0, 2.0, 3.0])]
    rows += [(8000 + k, [1e30 * x for x in rows[k][1]]) for k in range(3)] + [(8020, [1e-30] * 16)]
    rows += [(9000, None), (9020, []), (9040, [0.0] * 16), (9060, [1.0, None]), (9080, [float("nan")] * 16), (9100, [float("inf")] * 16), (None, [1.0] * 16)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = nearest.nearest_vectors(vectors(spark, rows), group_rows=group, least_slab=slab).collect()
    same(got, brute_nearest(rows))


def test_nearest_of_nothing(spark):
    for rows in ([], [(20, None)], [(20, [1.0])], [(1, [1.0]), (2, [1.0])]):
        assert nearest.nearest_vectors(vectors(spark, rows)).collect() == []
    few = nearest.nearest_vectors(vectors(spark, [(20, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [-1.0, 1.0])])).collect()
    assert [tuple(r) for r in few] == [(20, 1, 1, 2.0), (20, 2, 3, -1.0)]


def test_bounds_hold():
    random = np.random.default_rng(4)
    for scale in (1.0, 1e-20, 1e20):
        x = random.standard_normal((50, 24)) * scale * random.uniform(0.01, 100, (50, 1))
        r = nearest.Rounded(x)
        i, j = np.indices((50, 50)).reshape(2, -1)
        low, high = nearest.bounds(r, r, i, j, (r.codes[i].astype(float) * r.codes[j]).sum(axis=1))
        true = nearest.inner_products(x[i], x[j])
        assert ((low <= true) & (true <= high)).all()


# -- mended -------------------------------------------------------------------------------------


def test_deep_nesting_takes_linear_time():
    import time

    from fabtrail.llm import pages

    def took(n):
        page = "<html><body><article>" + "<div>" * n + "text" + "</span>" * 8 * n + "</div>" * n + "<p>end</p></article></body></html>"
        started = time.process_time()
        assert pages.blocks(page)[0] == ["text", "end"]
        return time.process_time() - started

    took(100)
    assert took(16_000) < 40 * max(took(1_600), 0.02)


def test_mixed_documents_count_each_source_by_itself(spark):
    from fabtrail.llm import mixing

    rows = [(k, " ".join(["w"] * 10), source) for source in "ab" for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = {r.source: r.target for r in mixing.mix(frame).select("source", "target").distinct().collect()}
    got = {r.source: 10 * r["count"] for r in mixing.mixed_documents(frame).groupBy("source").count().collect()}
    assert all(abs(got[s] - want[s]) <= 5 for s in want) and got["a"] < got["b"]


def test_quality_learns_from_one_row_of_an_id(spark):
    from fabtrail.llm import quality

    docs = spark.createDataFrame([(k % 40, f"some text of number {k % 40}. It is good.", "x") for k in range(4000)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    once = quality.learn(docs.dropDuplicates(["doc_id"]), labels)
    often = quality.learn(docs, labels)
    x = quality.features(__import__("pyarrow").array(["some text", "of number 3", ""]))
    assert (once.score(x) == often.score(x)).all()


def test_phrases_left_in_many_partitions_are_stored_in_few_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    many = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in many}
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    for key, value in many.items():
        spark.conf.set(key, value)
    try:
        phrases, _ = collocations.frequent_phrases(texts(spark, TEXTS), support=6)
        brute = brute_collocations(TEXTS, 6, 4, 10**6)
        assert {(r[0], r[2], r[3]) for r in brute} <= {(p.lang, p.phrase, p.a) for p in phrases.collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    for table in ("candidates", "phrases"):
        folders = list(tmp_path.glob(f"shared/fabtrail/*/{table}-*"))
        assert folders
        for folder in folders:
            assert 0 < len(list(folder.glob("part-*"))) <= spark.sparkContext.defaultParallelism
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_filter_of_candidates_is_small_and_loses_none(spark):
    keys = spark.range(100_000).select(F.xxhash64("id").alias("key"))
    bits = collocations._Bits(keys)
    own = keys.toArrow()["key"].to_numpy().view(np.uint64)
    others = spark.range(100_000, 300_000).select(F.xxhash64("id").alias("key")).toArrow()["key"].to_numpy().view(np.uint64)
    assert bits.hold(own).all()
    # at most four bytes for each key, whatever their number, and few false alarms
    assert bits._table.value.nbytes <= 4 * len(own)
    assert bits.hold(others).mean() < 0.01


def test_shards_come_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    with collocations._few_shards_at_once(spark):
        most = spark.range(0, 100, 1, 1).mapInArrow(sizes, "n bigint").agg(F.max("n")).first()[0]
    assert most == collocations.BATCH_SHARDS and spark.conf.get(name) == before

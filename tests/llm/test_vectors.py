import numpy as np
from pyspark.sql import functions as F

from fabtrail.llm import near_vectors


def brute(rows):
    usable = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, u) in enumerate(usable):
        for j, v in usable[a + 1 :]:
            if len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95:
                n[i] += 1
                n[j] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    least = {}
    for k, (vec_id, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), vec_id), vec_id)
    return [(vec_id, n[k], least[find(k)], vec_id == least[find(k)]) for k, (vec_id, _) in enumerate(rows)]


def table(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return frame.select("*", F.lit(1).alias("id"), F.lit(2).alias("hash"), F.lit(3).alias("vector"))


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 7)
    random = np.random.default_rng(3)
    centres = random.standard_normal((12, 64))
    rows = []
    for k in range(300):
        v = centres[k % 12] + 0.12 * random.standard_normal(64) if k % 3 else random.standard_normal(64)
        rows.append((1000 - k, [float(x) for x in np.float32(v)]))
    rows += [(2000 + k, rows[0][1]) for k in range(20)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [1.0, None]), (3004, [float("nan")] * 64), (3005, [float("inf")] + [0.0] * 63)]
    rows += [(3006, [1.0, 2.0]), (3007, [1.0, 2.01]), (3008, [-1.0, 2.0])]
    got = [tuple(r) for r in near_vectors.near_vectors(table(spark, rows)).collect()]
    want = brute(rows)
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found >= 0.9 * all_links
    more = {r[0]: r[1] for r in want}
    assert all(r[1] <= more[r[0]] for r in got)
    if found == all_links:
        assert sorted(got) == sorted(want)


def test_no_vectors(spark):
    assert near_vectors.near_vectors(table(spark, [])).collect() == []
    rows = [(1, None), (1, [0.0, 0.0])]
    assert [tuple(r) for r in near_vectors.near_vectors(table(spark, rows)).collect()] == [(1, 0, 1, True)] * 2


def test_repeated_rows_and_scaled_copies(spark):
    rows = [(5, [1.0, 0.5]), (5, [1.0, 0.5]), (3, [1e30, 5e29]), (4, [1e-30, 5e-31])]
    got = sorted(tuple(r) for r in near_vectors.near_vectors(table(spark, rows)).collect())
    assert got == [(3, 3, 3, True), (4, 3, 3, False), (5, 3, 3, False), (5, 3, 3, False)]

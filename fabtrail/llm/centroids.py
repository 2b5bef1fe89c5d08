"""Centroid clustering in exact integers, each vector's nearest centroid found by Orchard's search.

Every centroid has the list of the others in order of distance. A vector walks the list of the nearest centroid it has met; whenever
it meets a nearer one it goes on with that one's list, skipping those it has visited. It stops where the next centroid of the list is
strictly farther from the list's owner than twice the vector's distance from it: by the triangle inequality nothing from there on is
nearer, nor as near. The walk is taken by all vectors of a slice at once.

A round is one pass over the stored vectors: tasks hand on sums per centroid and component, Spark adds them up, and the few rows that
are left give the next centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fabtrail.session import stored

#: the contract's fixed values
SCALE = 1024
DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3

#: vectors that walk together
SLICE_ROWS = 8192

#: components below this have distances of 64 bits, and sums of a slice too; others are counted in Python's integers
SMALL = 1 << 26

#: components of double vectors are held to this
BOUND = 10.0**50

LARGEST = (1 << 63) - 1

#: sums are handed on as high and low parts, so that any size adds up exactly
LOW = 1 << 62


def _kept(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def scaled(batch: pa.RecordBatch, dims: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of each component: 64-bit integers, or Python's where some are too large for that."""
    x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    whole = np.floor(np.clip(x, -BOUND, BOUND) * scale)
    if not len(whole) or np.abs(whole).max() < SMALL:
        return whole.astype(np.int64)
    return np.array([[int(v) for v in row] for row in whole], dtype=object)


class Neighbours:
    """The centroids, and for each one the others by distance."""

    def __init__(self, centroids: list[list[int]]):
        exact = np.array(centroids, dtype=object).reshape(len(centroids), -1)
        small = max(abs(v) for row in centroids for v in row) < SMALL
        self.exact, self.small = exact, exact.astype(np.int64) if small else None
        gaps = ((exact[:, None, :] - exact[None, :, :]) ** 2).sum(axis=2)
        n = len(centroids)
        # squared distances to the others, nearest first; of equally near ones the smaller number first
        self.lists = np.array([sorted((k for k in range(n) if k != c), key=lambda k: (gaps[c][k], k)) for c in range(n)], np.int64).reshape(n, n - 1)
        self.gaps = np.array([[gaps[c][k] for k in row] for c, row in enumerate(self.lists.tolist())], dtype=object).reshape(n, n - 1)
        if small:
            self.gaps = self.gaps.astype(np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row the nearest centroid (of equally near ones the smallest number) and the squared distance; and how many were measured."""
        centroids = self.exact if x.dtype == object or self.small is None else self.small
        n, k = len(x), len(centroids)
        rows = np.arange(n)

        def measure(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
            return ((x[rows] - centroids[which]) ** 2).sum(axis=1)

        best = np.zeros(n, np.int64)
        distance = measure(rows, best)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        place = np.zeros(n, np.int64)
        measured = n
        walking = rows
        while len(walking):
            walking = walking[place[walking] < k - 1]
            owner, at = best[walking], place[walking]
            # twice the distance, squared
            within = (self.gaps[owner, at] <= 4 * distance[walking]).astype(bool)
            walking, owner, at = walking[within], owner[within], at[within]
            place[walking] += 1
            met = self.lists[owner, at]
            new = ~visited[walking, met]
            looked, met = walking[new], met[new]
            visited[looked, met] = True
            measured += len(looked)
            found = measure(looked, met)
            old = distance[looked]
            nearer = ((found < old) | ((found == old) & (met < best[looked]))).astype(bool)
            moved = looked[nearer]
            best[moved], distance[moved], place[moved] = met[nearer], found[nearer], 0
        return best, distance, measured


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _sums(vectors: DataFrame, neighbours, dims: int, scale: int) -> list:
    """``cluster, place, n, high, low``: how many vectors each centroid has, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = neighbours.value
        k = len(own.exact)
        counts = np.zeros(k, np.int64)
        totals = np.zeros((k, dims), dtype=object)
        for part in _slices(batches):
            x = scaled(part, dims, scale)
            which, _, _ = own.nearest(x)
            counts += np.bincount(which, minlength=k)
            for c in np.unique(which):
                totals[c] += x[which == c].sum(axis=0).astype(object)
        rows = [(c, p) for c in range(k) if counts[c] for p in range(dims)]
        high, low = ([Decimal(f(totals[c, p], LOW)) for c, p in rows] for f in (int.__floordiv__, int.__mod__))
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.int32()),
             pa.array([int(counts[c]) for c, _ in rows], pa.int64()), pa.array(high, pa.decimal128(38, 0)), pa.array(low, pa.decimal128(38, 0))],
            ["cluster", "place", "n", "high", "low"],
        )

    parts = vectors.mapInArrow(run, "cluster int, place int, n bigint, high decimal(38,0), low decimal(38,0)")
    # as many rows as there are centroids times components
    return parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()


def _assigned(vectors: DataFrame, neighbours, dims: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            which, distance, _ = neighbours.value.nearest(scaled(part, dims, scale))
            if distance.dtype == object:
                distance = np.array([min(d, LARGEST) for d in distance.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(which.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    return vectors.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def first_centroids(vectors: DataFrame, clusters: int, seed: int, dims: int, scale: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes; of one id those with the smallest components first, a null id last."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(sha.asc_nulls_last(), "vector").limit(clusters).select("vector").toArrow().to_batches()
    return [[int(v) for v in row] for batch in rows for row in scaled(batch, dims, scale).tolist()]


def centroid_clusters(
    rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """One row per vector kept: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors with ``dims`` components, none null or non-finite, are kept and turned into integers ``floor(scale * x)``. Centroids
    start as the ``clusters`` vectors (fewer, if there are fewer) with the smallest hashes of their ids. Each round assigns every
    vector to its nearest centroid, equally near ones to the smaller number, and replaces each centroid that has vectors by the
    floor of their mean, component by component; all is counted exactly. Distances are squared; those, and sums of them, beyond 63 bits are
    given as the largest long. Rows that repeat a vec_id are vectors of their own, a null vec_id too. Other columns are not
    read. An empty table, or one without such vectors, gives an empty result.
    """
    spark = rows.sparkSession
    vector = F.col("embedding")
    vectors = stored(
        rows.where(_kept(vector, dims)).select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector")), "vectors"
    )
    centroids = first_centroids(vectors, clusters, seed, dims, scale)
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        neighbours = spark.sparkContext.broadcast(Neighbours(centroids))
        moved = [list(c) for c in centroids]
        for row in _sums(vectors, neighbours, dims, scale):
            moved[row.cluster][row.place] = (int(row.high) * LOW + int(row.low)) // row.n
        if moved == centroids:
            # all later rounds would give the same
            break
        centroids = moved
    assigned = stored(_assigned(vectors, spark.sparkContext.broadcast(Neighbours(centroids)), dims, scale), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    total = min(sum(int(r["sum"]) for r in sums), LARGEST)
    told = [
        (r["cluster"], min(int(r["sum"]), LARGEST), total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest())
        for r in sums
    ]
    # one row per centroid
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(*[f.split()[0] for f in schema.split(", ")])


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in plain SQL, one pair of table expressions a round."""
    parts = [
        f"""q AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, sha256('{seed}:' || vec_id) AS sha,
         [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), qe AS MATERIALIZED (
  SELECT rid, unnest(range(0, {dims})) AS place, unnest(v) AS x FROM q
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha) - 1 AS cluster, v FROM q ORDER BY sha LIMIT {clusters}
)"""
    ]
    for k in range(rounds + 1):
        parts.append(
            f"""a{k} AS MATERIALIZED (
  SELECT rid, min(struct_pack(d := d, c := cluster)) AS best FROM (
    SELECT q.rid, c.cluster, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(q.v, c.v)])::BIGINT AS d FROM q, c{k} c
  ) GROUP BY rid
)"""
        )
        if k < rounds:
            parts.append(
                f"""c{k + 1} AS MATERIALIZED (
  SELECT c{k}.cluster, coalesce(m.v, c{k}.v) AS v FROM c{k} LEFT JOIN (
    SELECT cluster, list(m ORDER BY place) AS v FROM (
      SELECT best.c AS cluster, place, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
      FROM a{k} JOIN qe USING (rid) GROUP BY ALL
    ) GROUP BY cluster
  ) m USING (cluster)
)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance,
       (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN q USING (rid) JOIN c{rounds} c ON c.cluster = best.c
"""

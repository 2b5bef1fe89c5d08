"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors measured in double precision.

Queries are dealt into groups and candidates into slabs; each pair of a group and a slab is one tile, to which Spark brings both. A
task holds the tile's queries and streams the candidates past them in blocks. Vectors are rounded to 8 bits, so that a block's inner
products are one exact product of small integers; how far an inner product can be from that is bounded by the norms of what was
rounded off (Cauchy-Schwarz). A pair goes on only if its bound reaches the worst of the query's best so far, kept in a heap; those are measured on
the original vectors. What the heaps of all tiles hold is merged once more. Nothing near can be lost, so the result is that of brute force.

A bounded sample of candidates, met by all queries first, gives each query a bound to begin with, so that tiles hand on few rows. Of equal
vectors only as many as a query can take are candidates: the others are no nearer and have larger ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fabtrail.session import stored

NEAREST = 20
QUERY_EVERY = 20

#: queries of a group at most, held by a task
GROUP_ROWS = 1 << 16

#: candidates of a slab: about two for each query of a group, within these limits
LEAST_SLAB, MOST_SLAB = 1 << 11, 1 << 17

#: a block of candidates meets so many queries at once
BLOCK, QUERY_BLOCK = 1024, 1024

#: candidates of each length in the sample that gives the first bounds
SAMPLE = 1024

#: what the rounding of double arithmetic may add to a bound, as a share of the product of the norms
SLACK = 1e-9


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x.reshape(len(column), -1)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows, added up from the first component to the last."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


class Rounded:
    """Vectors as 8-bit integers times a step, with the norms that bound what the rounding changes."""

    def __init__(self, x: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore"):
            self.step = np.abs(x).max(axis=1) / 127
            self.step[self.step == 0] = 1e-300
            codes = np.rint(x / self.step[:, None])
            # single precision holds these sums exactly up to a thousand components
            self.codes = codes.astype(np.float32 if x.shape[1] <= 1000 else np.float64)
            near = codes * self.step[:, None]
            self.norm = np.sqrt((x * x).sum(axis=1))
            self.near_norm = np.sqrt((near * near).sum(axis=1))
            self.lost = np.sqrt(((x - near) ** 2).sum(axis=1)) + SLACK * self.norm


def bounds(q: Rounded, c: Rounded, rows: np.ndarray, cols: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that the inner products of some pairs can be."""
    with np.errstate(over="ignore", invalid="ignore"):
        about = product * q.step[rows] * c.step[cols]
        error = q.lost[rows] * c.norm[cols] + q.near_norm[rows] * c.lost[cols]
        return about - error, about + error


class Best:
    """For each query a heap of the nearest candidates met; its root is the worst of them."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, least: np.ndarray, nearest: int):
        self.x, self.rows, self.nearest = queries, rows, nearest
        self.rounded = Rounded(queries)
        self.heaps: list[list[tuple[float, int, int]]] = [[] for _ in rows]
        #: what a candidate must reach
        self.least = least.copy()

    def meet(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> int:
        """Take in a block of candidates; returns how many pairs were measured."""
        block = Rounded(x)
        measured = 0
        # largest values of the block bound what any pair of a query can differ by
        most_norm, most_lost = block.norm.max(), block.lost.max()
        for at in range(0, len(self.x), QUERY_BLOCK):
            own = np.arange(at, min(at + QUERY_BLOCK, len(self.x)))
            q = self.rounded
            with np.errstate(over="ignore", invalid="ignore"):
                product = q.codes[own] @ block.codes.T
                about = product * block.step.astype(product.dtype)
                error = q.lost[own] * most_norm + q.near_norm[own] * most_lost
                # the single-precision product with the step is off by less than a millionth of it
                floor = (self.least[own] - error - 1e-6 * q.norm[own] * most_norm) / q.step[own]
            i, j = np.nonzero(~(about < floor[:, None]))
            if not len(i):
                continue
            low, high = bounds(q, block, own[i], j, product[i, j].astype(np.float64))
            kept = ~(high < self.least[own[i]]) & (self.rows[own[i]] != rows[j])
            i, j, low = own[i[kept]], j[kept], low[kept]
            if len(i) > self.nearest * len(own):
                # as many of the block are sure to be this near
                i, j = self._within(i, j, low, block)
            for a in range(0, len(i), 1 << 16):
                measured += self._measure(x, ids, rows, i[a : a + (1 << 16)], j[a : a + (1 << 16)])
        return measured

    def _within(self, i: np.ndarray, j: np.ndarray, low: np.ndarray, block: Rounded) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of a query, sorted by query, those that the query's best of this block do not rule out."""
        order = np.lexsort((-np.nan_to_num(low, nan=-np.inf), i))
        i, j, low = i[order], j[order], low[order]
        starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        sizes = np.diff(np.append(starts, len(i)))
        full = sizes >= self.nearest
        worst = np.full(len(starts), -np.inf)
        worst[full] = np.nan_to_num(low[starts[full] + self.nearest - 1], nan=-np.inf)
        product = (self.rounded.codes[i].astype(np.float64) * block.codes[j]).sum(axis=1)
        _, high = bounds(self.rounded, block, i, j, product)
        kept = ~(high < np.repeat(worst, sizes))
        return i[kept], j[kept]

    def _measure(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> int:
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.nan_to_num(inner_products(self.x[i], x[j]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        near = scores >= self.least[i]
        for q, score, vec_id, row in zip(i[near].tolist(), scores[near].tolist(), ids[j[near]].tolist(), rows[j[near]].tolist()):
            heap, entry = self.heaps[q], (score, -vec_id, -row)
            if len(heap) < self.nearest:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.nearest:
                self.least[q] = max(self.least[q], heap[0][0])
        return len(i)

    def found(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.heaps), 4096):
            heaps = self.heaps[at : at + 4096]
            sizes = [len(h) for h in heaps]
            flat = [e for h in heaps for e in h]
            own = np.repeat(np.arange(at, at + len(heaps)), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.rows[own]), pa.array(query_ids[own]), pa.array([-e[1] for e in flat], pa.int64()),
                 pa.array([-e[2] for e in flat], pa.int64()), pa.array([e[0] for e in flat], pa.float64())],
                ["query", "query_id", "vec_id", "row", "score"],
            )


def first_sample(candidates: DataFrame) -> DataFrame:
    """Of each of the 16 commonest lengths at most ``SAMPLE`` vectors, drawn by their hashes."""
    common = candidates.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(16)
    hashed = F.xxhash64("row", F.lit("sample"))
    # about twice as many as are wanted come together
    drawn = candidates.join(F.broadcast(common), "dims").where(F.pmod(hashed, F.ceil(F.col("n") / (2 * SAMPLE))) == 0)
    order = Window.partitionBy("dims").orderBy(hashed, "row")
    return drawn.withColumn("_drawn", F.row_number().over(order)).where(F.col("_drawn") <= SAMPLE).select("row", "vector")


def _with_first_bound(queries: DataFrame, sample: DataFrame, nearest: int) -> DataFrame:
    """The queries with ``least``: the score of the worst of their nearest among a bounded sample; none where those are too few."""
    by_size: dict[int, tuple[list, list]] = {}
    for r in sample.collect():
        rows, vectors = by_size.setdefault(len(r.vector), ([], []))
        rows.append(r["row"])
        vectors.append(r.vector)
    held = queries.sparkSession.sparkContext.broadcast(
        {d: (np.array(rows, np.int64), np.array(v, np.float64)) for d, (rows, v) in by_size.items()}
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            least = np.full(batch.num_rows, -np.inf)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                if int(d) in held.value:
                    rows, x = held.value[int(d)]
                    part = batch.take(pa.array(own))
                    best = Best(_matrix(part.column("vector")), part.column("row").to_numpy(), least[own], nearest)
                    best.meet(x, rows, rows)
                    least[own] = best.least
            yield batch.append_column("least", pa.array(least))

    fields = ", ".join(f"{name} {kind}" for name, kind in queries.dtypes)
    return queries.mapInArrow(run, f"{fields}, least double")


def _tiles(placed: DataFrame, nearest: int) -> DataFrame:
    """The heaps of each tile: rows come sorted by tile, queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, best, query_ids = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dims", "grp", "slab", "role")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(at, to - at)
                own, role = tuple(keys[at, :3].tolist()), int(keys[at, 3])
                if own != tile:
                    if best is not None:
                        yield from best.found(query_ids)
                    tile, held, best = own, [], None
                if role == 0:
                    held.append(part.select(["row", "vec_id", "vector", "least"]))
                    continue
                if best is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    query_ids = table.column("vec_id").to_numpy()
                    best = Best(_matrix(table.column("vector")), table.column("row").to_numpy(), table.column("least").to_numpy(), nearest)
                for first in range(0, part.num_rows, BLOCK):
                    block = part.slice(first, BLOCK)
                    best.meet(_matrix(block.column("vector")), block.column("vec_id").to_numpy(), block.column("row").to_numpy())
        if best is not None:
            yield from best.found(query_ids)

    return placed.mapInArrow(run, "query bigint, query_id bigint, vec_id bigint, row bigint, score double")


def nearest_vectors(
    rows: DataFrame, nearest: int = NEAREST, query_every: int = QUERY_EVERY, group_rows: int = GROUP_ROWS, least_slab: int = LEAST_SLAB
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its nearest rows by inner product, nearest first, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``query_every``; candidates are all rows but the query's own. A query meets
    vectors of its own length. Null, empty and zero vectors, such with null or non-finite components, and rows without vec_id take no part. Rows that repeat a
    vec_id are queries and candidates of their own. A score beyond double precision is infinite; one that is undefined counts as
    the least. Other columns are not read. An empty table gives an empty result.
    """
    vectors = stored(
        rows.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.col("embedding").alias("vector"),
            F.size("embedding").alias("dims"),
            # stored with the row, so it stays
            F.monotonically_increasing_id().alias("row"),
        ),
        "vectors",
    )
    is_query = F.pmod("vec_id", F.lit(query_every)) == 0
    # a query can take so many of equal vectors, its own row included
    same = Window.partitionBy("vector").orderBy("vec_id", "row")
    candidates = vectors.withColumn("_same", F.row_number().over(same)).where(F.col("_same") <= nearest + 1).drop("_same")
    candidates = stored(candidates, "candidates")
    sample = first_sample(candidates)
    queries = stored(_with_first_bound(vectors.where(is_query), sample, nearest), "queries")
    n = F.count(F.lit(1))
    sizes = (
        queries.groupBy("dims").agg(n.alias("n_queries")).join(candidates.groupBy("dims").agg(n.alias("n")), "dims")
        .withColumn("groups", F.ceil(F.col("n_queries") / group_rows).cast("int"))
        .withColumn("slab_rows", F.least(F.lit(MOST_SLAB), F.greatest(F.lit(least_slab), F.ceil(F.col("n_queries") / F.col("groups")) * 2)))
        .withColumn("slabs", F.ceil(F.col("n") / F.col("slab_rows")).cast("int"))
        .select("dims", "groups", "slabs")
    )
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
    asking = queries.join(sizes, "dims").select(
        "dims", deal("groups").alias("grp"), every("slabs").alias("slab"), F.lit(0).alias("role"), "row", "vec_id", "vector", "least"
    )
    asked = candidates.join(sizes, "dims").select(
        "dims", every("groups").alias("grp"), deal("slabs").alias("slab"), F.lit(1).alias("role"), "row", "vec_id", "vector",
        F.lit(0.0).alias("least"),
    )
    tile = ["dims", "grp", "slab"]
    placed = asking.unionByName(asked).repartition(*tile).sortWithinPartitions(*tile, "role", "row")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    merged = _tiles(placed, nearest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return merged.select("query_id", "rank", "vec_id", "score")


#: ranks by inner products added up in the order of the components
ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, [x::DOUBLE for x in embedding] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {NEAREST}
"""

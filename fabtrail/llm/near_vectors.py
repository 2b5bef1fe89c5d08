"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations are learned (from a bounded sample) so that the signs of the rotated vector are balanced bits that keep angles: PCA
axes, then turns that bring the vectors close to the corners of a cube. Several rotations from different starts give a
code of several times the vector's dimensions. The code is cut into tables; two vectors meet where they agree in a whole table,
so codes that differ in fewer bits than there are tables always meet. Vectors that meet are compared by their exact cosine in double
precision; a pair that meets in several tables counts in the first of them only.

Equal vectors are one class from the start and are not compared with each other. Buckets of any size are joined
in blocks, so nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fabtrail.llm.graph import components
from fabtrail.session import stored

COSINE = 0.95

#: vectors the rotations are learned from: those with the smallest hashes
SAMPLE = 20_000
TURNS = 40

#: the code's bits are cut into tables of so many
TABLE_BITS = 16

#: tables at least; rotations are added until the code has them
TABLES = 16

#: a bucket is joined in blocks of this many vectors
BLOCK = 512

#: pairs that are compared at once
PAIRS_AT_ONCE = 200_000


def learn_rotations(sample: np.ndarray, n_rotations: int, turns: int = TURNS, seed: int = 7) -> np.ndarray:
    """``(n_rotations, dimensions, dimensions)``: turned PCA axes whose signs are the bits."""
    dims = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample)
    projected = sample @ axes
    random = np.random.default_rng(seed)
    out = []
    for _ in range(n_rotations):
        turn, _ = np.linalg.qr(random.standard_normal((dims, dims)))
        for _ in range(turns):
            corners = np.where(projected @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(corners.T @ projected)
            turn = (u @ v).T
        out.append(axes @ turn)
    return np.array(out)


def code_tables(unit: np.ndarray, rotations: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The table entries of each vector: ``(vectors, tables)`` integers of ``bits`` bits."""
    signs = np.concatenate([unit @ r >= 0 for r in rotations], axis=1)[:, : bits * tables]
    weights = 1 << np.arange(bits, dtype=np.int64)
    return signs.reshape(len(unit), tables, bits) @ weights


def _usable(vector):
    """Null, empty, zero and non-finite vectors, and vectors with such components, link with nothing."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & some, F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _unit(x: np.ndarray) -> np.ndarray:
    # the largest component first, so that neither large nor small numbers leave the range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _buckets(vectors: DataFrame, dims: int, rotations, bits: int, tables: int) -> DataFrame:
    """``id, dup, codes, vector`` with one row for each table: ``tab, code``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = np.frombuffer(rotations.value, np.float64).reshape(-1, dims, dims)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                codes = code_tables(_unit(_matrix(part.column("vector"), dims)), turned, bits, tables)
                rows = np.repeat(np.arange(part.num_rows), tables)
                own = pa.array([c.tobytes() for c in codes.astype("<i4")], pa.binary())
                columns = {c: part.column(c).take(pa.array(rows)) for c in ("id", "dup", "vector")}
                yield pa.RecordBatch.from_pydict(
                    columns | {"codes": own.take(pa.array(rows)), "code": pa.array(codes.ravel().astype(np.int32)),
                               "tab": pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows))}
                )

    kind = dict(vectors.dtypes)["vector"]
    return vectors.mapInArrow(run, f"id bigint, dup bigint, vector {kind}, codes binary, code int, tab int")


def _linked_in_buckets(placed: DataFrame, dims: int, tables: int, cosine: float) -> DataFrame:
    """``id, links, other``: for each vector of a bucket the linked vectors counted there, and a vector of its local component.

    Rows come sorted by place (``tab, code, x, y``); a place is one bucket, or two blocks of a large one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4096:
                table = pa.Table.from_batches(held).combine_chunks()
                place = _place_starts(table)
                # the last place may go on in the next batch
                last = int(place[-1])
                if last:
                    yield from _join(table.slice(0, last), place[:-1])
                held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if table.num_rows:
                yield from _join(table, _place_starts(table))

    def _place_starts(table: pa.Table) -> np.ndarray:
        cols = [table.column(c).to_numpy() for c in ("tab", "code", "x", "y")]
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    def _join(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        n = table.num_rows
        unit = _unit(_matrix(table.column("vector").combine_chunks(), dims))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), "<i4").reshape(n, tables)
        ids, dup = table.column("id").to_numpy(), table.column("dup").to_numpy()
        tab = table.column("tab").to_numpy()
        own, x, y = (table.column(c).to_numpy() for c in ("own", "x", "y"))
        sizes = np.diff(np.concatenate([starts, [n]]))
        # each row meets the later rows of its place
        end = np.repeat(starts + sizes, sizes)
        later = end - np.arange(n) - 1
        done = np.cumsum(later)
        at = 0
        found_i, found_j = [], []
        while at < n:
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            reps = later[at:to]
            i = np.repeat(np.arange(at, to), reps)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps)
            # two blocks meet in a place of their own; inside a block pairs belong to the block's own place
            cross = (x[i] == y[i]) | (own[i] != own[j])
            i, j = i[cross], j[cross]
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            i, j = i[near], j[near]
            first = (codes[i] == codes[j]).argmax(axis=1) == tab[i]
            found_i.append(i[first])
            found_j.append(j[first])
            at = to
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        links = np.bincount(i, dup[j], n) + np.bincount(j, dup[i], n)
        # local components: the least id is handed on until nothing changes
        label = ids.copy()
        while True:
            least = label.copy()
            np.minimum.at(least, i, label[j])
            np.minimum.at(least, j, label[i])
            if (least == label).all():
                break
            label = least
        out = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_pydict(
            {"id": pa.array(ids[out]), "links": pa.array(links[out].astype(np.int64)), "other": pa.array(label[out])}
        )

    return placed.mapInArrow(run, "id bigint, links bigint, other bigint")


def _class_links(vectors: DataFrame, dims: int, cosine: float, bits: int, tables: int) -> DataFrame:
    """``id, links, other`` for distinct vectors of one length (columns ``id, dup, vector``)."""
    spark = vectors.sparkSession
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    sample = _unit(np.array([r.vector for r in chosen], np.float64))
    n_rotations = -(-bits * tables // dims)
    rotations = spark.sparkContext.broadcast(learn_rotations(sample, n_rotations).tobytes())
    rows = stored(_buckets(vectors, dims, rotations, bits, tables), "buckets")
    sizes = rows.groupBy("tab", "code").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size")
    met = rows.join(sizes, ["tab", "code"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "dup", "vector", "codes", "tab", "code", "own",
        F.least("own", "_other").alias("x"), F.greatest("own", "_other").alias("y"),
    )
    at = ["tab", "code", "x", "y"]
    placed = placed.repartition(*at).sortWithinPartitions(*at)
    return _linked_in_buckets(placed, dims, tables, cosine)


def near_vectors(
    rows: DataFrame, cosine: float = COSINE, bits: int = TABLE_BITS, tables: int = TABLES
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link when their cosine, in double precision, is at least ``cosine``; every pair is compared whose codes agree in
    a table. ``n_links`` counts the other vectors linked directly, equal ones too. Null, empty and zero vectors, and
    such with null or non-finite components, link with nothing; neither do vectors of different lengths. Rows that repeat a
    vec_id are vectors of their own, with the same component if they are equal. A null vec_id is never a component's least. Other
    columns are not read.
    """
    vectors = stored(
        rows.select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            _usable(F.col("embedding")).alias("usable"),
            F.col("embedding").alias("vector"),
        ),
        "vectors",
    )
    usable = vectors.where("usable")
    # -0.0 and 0.0 are equal here, as grouping makes them one
    same = usable.withColumn("hash", F.xxhash64(F.transform("vector", lambda x: x + F.lit(0).cast("float"))))
    grouped = same.groupBy("hash").agg(F.count(F.lit(1)).alias("dup"), F.min("vec_id").alias("least"), F.any_value("vector").alias("vector"))
    classes = stored(grouped.select(F.col("hash").alias("id"), "dup", "least", "vector"), "vector-classes")
    found = None
    for row in classes.groupBy(F.size("vector").alias("dims")).count().orderBy("dims").collect():
        # one pass for each length that occurs
        own = classes.where(F.size("vector") == row.dims).select("id", "dup", "vector")
        links = _class_links(own, row.dims, cosine, bits, tables)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "id bigint, links bigint, other bigint")
    found = stored(found, "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    told = (
        classes.select("id", "dup", "least")
        .join(counts, "id", "left")
        .join(parts, "id", "left")
        .withColumn("component", F.coalesce("component_id", "id"))
    )
    least = told.groupBy("component").agg(F.min("least").alias("first"))
    per_class = told.join(least, "component").select(
        F.col("id").alias("hash"),
        (F.coalesce("links", F.lit(0)) + F.col("dup") - 1).alias("n_links"),
        F.col("first").alias("component_id"),
    )
    linked = same.select("vec_id", "hash").join(per_class, "hash").select("vec_id", "n_links", "component_id")
    alone = vectors.where("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

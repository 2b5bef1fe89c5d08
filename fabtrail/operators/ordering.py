"""Ranks, group offsets and lookups that never put a whole group into one task.

A window over a key puts all rows of the key into one task, so one busy tool or file would
decide the run time. Here rows are range-partitioned by the *whole* sort key, which splits
a busy key over many partitions, and numbered through; values of a group are pre-aggregated
per partition and joined back per (group, partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fabtrail.session import stored

#: columns added by :func:`number_rows`
POSITION = "_pos"
SLICE = "_slice"

_ROW_BITS = 33


#: bytes of the plan's estimate that one range slice takes at most
SLICE_BYTES = 256 << 20


def order_partitions(df: DataFrame) -> int:
    """Range slices for a frame: the session's shuffle partitions, or more where the input is large."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # joins multiply the estimate, so it is not followed without end
    return max(usual, min(estimate // SLICE_BYTES, 100 * usual))


def number_rows(df: DataFrame, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """Number all rows 0, 1, 2 … in ``order`` (which should end in a unique column).

    Adds ``_pos``, the dense number, and ``_slice``, the range partition the row fell into.
    One shuffle; the result is stored, as places must not change between its uses. ``parts`` gives the number of
    range slices, where more is known than the plan's estimate.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = parts or order_partitions(df)
    placed = stored(
        df.repartitionByRange(parts, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    )
    placed = placed.withColumn(SLICE, F.shiftright("_place", _ROW_BITS))
    # one row per partition: as many as shuffle partitions, whatever the data
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(SLICE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    in_slice = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(starts), SLICE)
        .withColumn(POSITION, in_slice + F.col("_start"))
        .drop("_place", "_start")
    )


def group_values(numbered: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregate ``keys`` over numbered rows: one row per group and slice the group lies in.

    Groups must be contiguous in the numbering. Joining the result back on
    ``keys + [_slice]`` meets at most one slice's rows per key.
    """
    found = numbered.groupBy(*keys).agg(
        F.min(SLICE).alias("_from"),
        F.max(SLICE).alias("_to"),
        *[c.alias(n) for n, c in aggregates.items()],
    )
    return found.select(
        *keys, *aggregates, F.explode(F.sequence("_from", "_to")).alias(SLICE)
    )


def with_group_values(numbered: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Numbered rows with aggregates of their group."""
    return join_group_values(numbered, group_values(numbered, keys, **aggregates), keys)


def join_group_values(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the values of their group, met per slice; null keys are a group too."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, SLICE]]
    added = [c for c in values.columns if c not in (*keys, SLICE)]
    return rows.alias("l").join(values.alias("r"), same).select("l.*", *[f"r.{c}" for c in added])


def occurrence_number(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number equal rows 0, 1, 2 … ; ``keys`` are the columns that make rows equal."""
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    numbered = number_rows(hashed, ["_hash", *keys])
    return (
        with_group_values(numbered, keys, _first=F.min(POSITION))
        .withColumn(name, F.col(POSITION) - F.col("_first"))
        .drop("_hash", "_first", POSITION, SLICE)
    )


#: a key is heavy when it holds at least this share of the rows, so there are at most 1000
HEAVY_SHARE = 1000


def heavy_keys(counts: DataFrame, keys: list[str], weight: str = "_n") -> DataFrame:
    """Keys with at least a thousandth of all rows: never more than 1000 rows."""
    total = counts.agg(F.sum(weight)).scalar()
    return counts.where(F.col(weight) * HEAVY_SHARE >= total).select(*keys)


def lookup_join(
    df: DataFrame, lookup: DataFrame, keys: list[str], counts: DataFrame | None = None
) -> DataFrame:
    """Left join of ``df`` with a ``lookup`` that has one row per key, safe for heavy keys.

    The lookup rows of heavy keys (at most 1000, by their share) go to every task; all other
    rows meet by shuffle. Rows of heavy keys are spread over the shuffle by a random-like
    filler, so no task gets all of them. ``counts`` may give rows per key (column ``_n``);
    else they are counted, reading the key columns only.
    """
    values = [c for c in lookup.columns if c not in keys]
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    heavy = heavy_keys(counts, keys)
    found = lookup.join(F.broadcast(heavy), keys, "left_semi")
    # heavy keys the lookup does not have are marked too, else their rows would all meet
    heavy_rows = heavy.join(found, keys, "left").select(
        *keys, F.struct(*values).alias("_heavy"), F.lit(True).alias("_is_heavy")
    )
    left = df.join(F.broadcast(heavy_rows), keys, "left")
    settled = F.coalesce(F.col("_is_heavy"), F.lit(False))
    for key in keys:
        settled = settled | F.col(key).isNull()
    # the second join key follows from the key for light rows; that of a settled row from the
    # whole row, so it finds no partner and spreads the rows (a constant here would be taken
    # out of the join keys by the optimizer, and spread nothing)
    of_key = F.xxhash64(*keys)
    filler = F.when(settled, F.xxhash64(*[F.col(c) for c in _hashable(df)])).otherwise(of_key)
    left = left.withColumn("_spread", filler)
    light = lookup.select(*keys, F.struct(*values).alias("_light")).withColumn("_spread", of_key)
    joined = left.join(light, [*keys, "_spread"], "left")
    picked = lambda c: F.when(F.col("_is_heavy"), F.col("_heavy")[c]).otherwise(F.col("_light")[c])
    return joined.select(*[F.col(c) for c in df.columns], *[picked(c).alias(c) for c in values])


def _hashable(df: DataFrame) -> list[str]:
    """Columns a hash can be taken of."""
    return [
        f.name
        for f in df.schema
        if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))
    ]

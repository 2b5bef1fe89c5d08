"""Connected components of links, by alternating star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fabtrail.session import stored_in_few


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with ``m``, the least of u and all its v; a vertex of any degree is pre-aggregated."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("_u")).drop("_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    met = _with_least(edges)
    low = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component_id`` of all ids in ``links`` (two columns ``a, b``); the component is its least id.

    Each step keeps at most as many edges as there were; a path of n links takes about log n steps.
    Steps are stored in the shared folder, so a lost executor costs one step.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored_in_few(edges, "links", links.count())
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        edges = stored_in_few(_small_star(_large_star(edges)), "links", mark[0])
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)

"""The queries of the numbered operators, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fabtrail.llm import (
    centroids,
    collocations,
    context_tree,
    exact_dedup,
    jaccard_join,
    mixing,
    near_vectors,
    nearest,
    packing,
    pages,
    pseudonyms,
    quality,
    token_files,
)

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: the key of the pseudonyms; a deployment hands in its own secret
PSEUDONYM_KEY = "pseudonyms of documents"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(_table(spark, sf_dir, "documents"), TOKENIZER)


def op2_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(_table(spark, sf_dir, "pages"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scores(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_main_texts,
        op3_context_tree,
        op4_mix_sources,
        op5_pseudonyms,
        op6_jaccard_join,
        op7_quality,
        op8_near_vectors,
        op9_harmonic_packing,
        op10_exact_dedup,
        op11_centroids,
        op12_collocations,
        op13_nearest,
    )
}

ORACLE: dict[str, str] = {
    "op4_mix_sources": mixing.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_centroids": centroids.oracle_sql(),
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_nearest": nearest.ORACLE_SQL,
}

"""Files as frames: listing, heads, lines and whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fabtrail.functions import sniff
from fabtrail.functions.signatures import file_signature
from fabtrail.functions.text import EXTRA_LINE_ENDS, base_name


def list_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(source_path, source_filename, length)``; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return found.select(
        F.col("path").alias("source_path"),
        base_name(F.col("path")).alias("source_filename"),
        "length",
    )


def _located(path: str):
    """(file system, path inside it) of a location any worker can reach."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def open_stream(path: str):
    """A byte stream over a file."""
    system, inner = _located(path)
    return system.open_input_stream(inner)


def open_file(path: str):
    """A file that can be read at any place."""
    system, inner = _located(path)
    return system.open_input_file(inner)


def output_stream(path: str):
    """A stream that creates or replaces a file."""
    system, inner = _located(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def plain_path(encoded: Column) -> Column:
    """A file path from its URL-encoded form in the file metadata."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def file_place(row: Column | None = None) -> list[Column]:
    """``source_path, source_filename, block`` (and ``row``) of the rows of a file scan."""
    path = plain_path(F.col("_metadata.file_path"))
    place = [
        path.alias("source_path"),
        base_name(path).alias("source_filename"),
        F.col("_metadata.file_block_start").alias("block"),
    ]
    return place if row is None else [*place, row.alias("row")]


def read_heads(
    spark: SparkSession, paths: list[str] | str, n_bytes: int = 8192, via: str = "stream"
) -> DataFrame:
    """Listing plus ``head``, the first bytes of every file.

    ``via="stream"`` opens each file in a task and reads its head only; ``via="content"``
    serves storage the workers cannot open by path, at the cost of reading whole files.
    """
    if via == "content":
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        return found.select(
            F.col("path").alias("source_path"),
            base_name(F.col("path")).alias("source_filename"),
            "length",
            F.substring("content", 1, n_bytes).alias("head"),
        )

    # the listing is packed by file size; opening files takes time per file
    return heads_of(list_files(spark, paths), n_bytes)


def heads_of(files: DataFrame, n_bytes: int) -> DataFrame:
    """Listed files (``source_path, source_filename, length``) with ``head``, their first bytes."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["source_path"]:
                with open_stream(path) as stream:
                    found.append(stream.read(n_bytes))
            yield batch.assign(head=found)

    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("source_path", "source_filename", "length").repartition(tasks).mapInPandas(
        heads, "source_path string, source_filename string, length bigint, head binary"
    )


def classify(heads: DataFrame) -> DataFrame:
    """Heads plus ``admitted``, ``format`` and ``signature``: one row per file."""
    from fabtrail.sources.binary import head_has_fields

    name, head = F.col("source_filename"), F.col("head")
    return (
        heads.withColumn("admitted", sniff.admit(name, head))
        .withColumn("_fields", F.when(sniff.has_nul(head), head_has_fields(head)))
        .withColumn("format", sniff.dispatch_format(name, head, F.coalesce("_fields", F.lit(False))))
        .withColumn("signature", file_signature(name, head))
        .drop("_fields")
    )


def _escaped(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else bytes(v).decode("utf-8", errors="backslashreplace"))


def escaped_text(value: Column) -> Column:
    """Text in which bytes that are no UTF-8 are written as ``\\xhh``; only such texts leave the JVM."""
    broken = ~F.is_valid_utf8(value)
    shown = F.pandas_udf(_escaped, "string")(F.when(broken, value.cast("binary")))
    return F.when(broken, shown).otherwise(value)


def read_lines(spark: SparkSession, paths: list[str] | str, escape: bool = False) -> DataFrame:
    """``(source_path, source_filename, block, row, line)``, splittable inside files.

    ``(block, row)`` orders the lines of a file: start of the file split, place in the task. Bytes that are no
    UTF-8 become replacement characters, or are escaped.
    """
    text = escaped_text(F.col("value")) if escape else F.make_valid_utf8("value")
    return (
        spark.read.text(paths, recursiveFileLookup=True)
        .select(*file_place(), text.alias("text"))
        .select("source_path", "source_filename", "block", F.explode(F.split("text", EXTRA_LINE_ENDS)).alias("line"))
        .withColumn("row", F.monotonically_increasing_id())
    )


def read_whole(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(source_path, source_filename, block, content)``: one row per file."""
    return spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(
        *file_place(), F.make_valid_utf8("value").alias("content")
    )

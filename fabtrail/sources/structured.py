"""Parsers for JSON, CSV/TSV, XML and Parquet: frames with an ``entries`` column."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fabtrail.functions import entries as E
from fabtrail.functions.text import let, number_text, split_lines, strip
from fabtrail.schema import ENTRIES
from fabtrail.operators.ordering import lookup_join
from fabtrail.session import barrier, spread, stored
from fabtrail.sources import splits
from fabtrail.sources.files import (
    file_place,
    heads_of,
    open_file,
    open_stream,
    plain_path,
    read_lines,
    read_whole,
)

PLACE = ["source_path", "source_filename", "block", "row"]

_PLACE_FIELDS = [
    T.StructField("source_path", T.StringType()),
    T.StructField("source_filename", T.StringType()),
    T.StructField("block", T.LongType()),
    T.StructField("row", T.LongType()),
]

# -- JSON ------------------------------------------------------------------------------

def _object_line(line: Column) -> Column:
    """A line without the comma that ends it; null if it starts no object."""
    return let(
        F.rtrim(strip(line), F.lit(",")), lambda text: F.when(text.startswith("{"), text)
    )


def json_line_entries(line: Column) -> Column:
    """Entries of one line of newline-delimited JSON; null for anything but an object."""
    return E.json_entries(_object_line(line))


def object_texts(content: Column) -> Column:
    """The objects of a JSON document: of an array, else those that start the lines."""
    none = F.array().cast("array<string>")

    def objects(text: Column) -> Column:
        lines = F.array_compact(F.transform(split_lines(text), _object_line))
        return (
            F.when(text.startswith("["), F.coalesce(array_objects(text), none))
            .when(text.startswith("{"), lines)
            .otherwise(none)
        )

    return let(strip(content), objects)


def parse_json_lines(df: DataFrame) -> DataFrame:
    """``line`` to ``entries``; lines that are no JSON object are skipped."""
    parsed = barrier(df.withColumn("entries", json_line_entries(F.col("line"))).drop("line"))
    return parsed.where(F.col("entries").isNotNull())


def array_objects(content: Column) -> Column:
    """The objects of a JSON array as texts; null when the content is no array."""

    def objects(text: Column) -> Column:
        items = F.from_json(text, "array<string>")
        is_object = F.transform(
            F.from_json(text, "array<variant>"),
            lambda v: F.schema_of_variant(v).startswith("OBJECT"),
        )
        kept = let(
            is_object,
            lambda flags: F.filter(items, lambda x, i: F.coalesce(F.get(flags, i), F.lit(False))),
        )
        return F.when(text.startswith("["), kept)

    return let(strip(content), objects)


def parse_json_arrays(df: DataFrame) -> DataFrame:
    """``content`` to one row of ``entries`` per object in the array."""
    others = [c for c in df.columns if c not in ("content", "row")]
    return (
        df.select(*others, F.posexplode(array_objects(F.col("content"))).alias("row", "_object"))
        .withColumn("row", F.col("row").cast("bigint"))
        .withColumn("entries", E.json_entries(F.col("_object")))
        .drop("_object")
    )


def read_json_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return parse_json_lines(read_lines(spark, paths))


def read_json_arrays(files: DataFrame) -> DataFrame:
    """Array files (``source_path, source_filename``) of any size to one row of ``entries`` per object.

    Spark splits the files; every task cuts its splits into objects. A file that is no array as a whole gives none.
    """
    spark = files.sparkSession
    paths = [row.source_path for row in files.select("source_path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], T.StructType([*_PLACE_FIELDS, T.StructField("entries", ENTRIES)]))
    found, faults = splits.records(spark, paths, splits.JsonArray())
    sound = found.join(faults.select("source_path").distinct(), "source_path", "left_anti")
    return sound.select(*PLACE, E.json_entries(F.col("content")).alias("entries"))


# -- CSV and TSV -------------------------------------------------------------------------


def csv_profiles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Per file: the delimiter and whether a quoted cell runs over a line end.

    One pre-aggregated pass over the whole texts, as the delimiter is the more frequent
    of tab and comma in the whole file.
    """
    value = F.col("value")
    without = lambda ch: F.length(F.replace(value, F.lit(ch), F.lit("")))
    return (
        spark.read.text(paths)
        .select(
            plain_path(F.col("_metadata.file_path")).alias("source_path"),
            (F.length(value) - without("\t")).alias("tabs"),
            (F.length(value) - without(",")).alias("commas"),
            (F.length(value) - without('"')).alias("quotes"),
        )
        .groupBy("source_path")
        .agg(
            F.when(F.sum("tabs") > F.sum("commas"), F.lit("\t")).otherwise(F.lit(",")).alias("sep"),
            F.bool_or(F.col("quotes") % 2 == 1).alias("open_quotes"),
        )
    )


def csv_headers(profiles: DataFrame) -> DataFrame:
    """Profiles plus ``header``: the cells of the first row of each file."""

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for batch in batches:
            found = []
            for path, sep in zip(batch["source_path"], batch["sep"]):
                with open_stream(path) as stream:
                    text = io.TextIOWrapper(stream, "utf-8", errors="replace", newline="")
                    rows = csv.reader(text, delimiter=sep)
                    found.append(next((row for row in rows if row), []))
            yield batch.assign(header=found)

    return profiles.mapInPandas(
        headers, "source_path string, sep string, open_quotes boolean, header array<string>"
    )


def cells_to_entries(header: list[str], cells: list[Column]) -> Column:
    """Entries of one row of cells; nameless columns are dropped, missing cells are null."""
    pairs = [
        E.text_entry(F.lit(name.strip()), strip(cell))
        for name, cell in zip(header, cells)
        if name
    ]
    found = F.array(*pairs) if pairs else E.empty_entries()
    stripped = [name.strip() for name in header if name]
    return found if len(set(stripped)) == len(stripped) else E.dedupe(found)


def read_csv_group(
    spark: SparkSession, paths: list[str], header: list[str], sep: str, multi_line: bool
) -> DataFrame:
    """Files sharing one header, split inside files whether or not cells hold line ends."""
    names = [f"c{i}" for i in range(len(header))]
    # the text of a row is kept only where its number of cells is wrong
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_row_text"]])
    options = {
        "sep": sep,
        "quote": '"',
        "escape": '"',
        "multiLine": multi_line,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_row_text",
        "emptyValue": "",
    }
    if multi_line:
        texts, _ = splits.records(spark, paths, splits.QuotedLines())
        line = F.rtrim(F.col("content"), F.lit("\r\n"))
        # a file's first row that is not empty names its columns
        filled = barrier(texts.withColumn("line", line).where(F.trim("line") != ""))
        first = filled.groupBy("source_path").agg(F.min(F.struct("block", "row")).alias("first"))
        told = _told(filled, stored(first, "csv-first"), spark)
        cells = F.from_csv("line", schema.simpleString()[len("struct<") : -1].replace(":", " "), {k: str(v) for k, v in options.items()})
        rows = told.where(F.struct("block", "row") != F.col("first")).select(*PLACE, cells.alias("cells"))
        rows = barrier(rows).select(*PLACE, "cells.*")
    else:
        # wrong numbers of cells show only when whole rows are parsed
        read = spark.read.schema(schema).options(**options).option("header", True).option("columnPruning", False).csv(paths)
        rows = read.select(*file_place(F.monotonically_increasing_id()), *schema.names)
    return rows.select(
        *PLACE,
        cells_to_entries(
            header,
            [
                F.when(F.col("_row_text").isNull(), F.coalesce(F.col(n), F.lit(""))).otherwise(
                    F.col(n)
                )
                for n in names
            ],
        ).alias("entries"),
        (F.col("_row_text").isNotNull() & F.col(names[-1]).isNull()).alias("short"),
    )


def _told(rows: DataFrame, facts: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows with the facts of their file (one row for each ``source_path``)."""
    if facts.count() <= splits.MOST_BROADCAST_SPLITS:
        return rows.join(F.broadcast(facts), "source_path")
    return lookup_join(rows, facts, ["source_path"])


# -- XML -----------------------------------------------------------------------------------


#: bytes of a file in which the root's start tag is looked for
XML_HEAD_BYTES = 1 << 16

#: records, and about so many characters of them, that one parser takes
XML_AT_ONCE, XML_CHARS_AT_ONCE = 256, 1 << 20

_XML_NAME = r"[A-Za-z_:][\w:.\-]*"
#: what may stand before the root: declaration, comments, document type
_XML_PROLOG = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>\s*)*"


def xml_roots(files: DataFrame) -> DataFrame:
    """``source_path, source_filename, root_tag, root``: the root's start tag and its name; empty where there is none."""
    text = F.make_valid_utf8(F.col("head").cast("string"))
    body = F.regexp_replace(text, _XML_PROLOG, "")
    opening = F.regexp_extract(body, rf"(?s)^<{_XML_NAME}(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", 0)
    root = F.regexp_extract(opening, rf"^<({_XML_NAME})", 1)
    return heads_of(files, XML_HEAD_BYTES).select("source_path", "source_filename", opening.alias("root_tag"), root.alias("root"))


def _xml_fields(node) -> list[tuple[str, str, str]]:
    """Attributes, then the children's texts and attributes; the text of a node without children is its message."""
    pairs = list(node.items())
    for child in node:
        pairs.append((child.tag, child.text or ""))
        if child.attrib:
            pairs.extend((f"{child.tag}_{name}", value) for name, value in child.items())
    own = (node.text or "").strip()
    if own and not len(node) and "message" not in node.keys():
        pairs.append(("message", own))
    return [(name, value, "S") for name, value in dict(pairs).items()]


def _xml_records(root_tag: str, root: str, texts: list[str]) -> Iterator[tuple[int, list[tuple[str, str, str]] | None, str | None]]:
    """Number of the text, fields, error of the elements in texts that stand below one root tag."""
    from xml.etree import ElementTree

    def parsed(own: list[str]) -> list:
        # names of the root's namespaces hold in its children
        return list(ElementTree.fromstring("".join([root_tag, *own, "</", root, ">"])))

    # one parser for many records; where a record is not well-formed, or not one element, each has its own
    try:
        nodes = parsed(texts)
    except ElementTree.ParseError:
        nodes = []
    if len(nodes) == len(texts):
        for k, node in enumerate(nodes):
            yield k, _xml_fields(node), None
        return
    for k, text in enumerate(texts):
        try:
            nodes = parsed([text])
        except ElementTree.ParseError as error:
            yield k, None, str(error)
            continue
        for node in nodes:
            yield k, _xml_fields(node), None


def read_xml(files: DataFrame) -> DataFrame:
    """``source_path, source_filename, length`` rows to one row for each child of each root: ``entries``, or the ``error`` of a
    child that is not well-formed or of a file that ends too early (``entries`` is null then).

    Spark splits the files; elements are told apart by their depth, whatever their names. A task parses a few records at a time. A
    file that ends too early loses the record it breaks off in only.
    """
    spark = files.sparkSession
    schema = T.StructType([*_PLACE_FIELDS, T.StructField("entries", ENTRIES), T.StructField("error", T.StringType())])
    paths = [row.source_path for row in files.select("source_path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], schema)
    roots = stored(xml_roots(files), "xml-roots")
    found, faults = splits.records(spark, paths, splits.Xml())
    pieces = _told(found, roots.select("source_path", "root_tag", "root"), spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, roots_, texts = (batch.column(c).to_pylist() for c in ("root_tag", "root", "content"))
            at = 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and to - at < XML_AT_ONCE and size < XML_CHARS_AT_ONCE and tags[to] == tags[at] and roots_[to] == roots_[at]:
                    size += len(texts[to])
                    to += 1
                of_row, counts, errors, triples = [], [], [], []
                for k, fields, error in _xml_records(tags[at], roots_[at], texts[at:to]):
                    if fields or error is not None:
                        of_row.append(at + k)
                        counts.append(len(fields) if error is None else None)
                        errors.append(error)
                        triples += fields or []
                if of_row:
                    sizes = [n or 0 for n in counts]
                    offsets = [None if n is None else end - n for n, end in zip(counts, accumulate(sizes))]
                    keys, values, kinds = zip(*triples) if triples else ((), (), ())
                    members = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (keys, values, kinds)], ["key", "value", "kind"])
                    entries = pa.ListArray.from_arrays(pa.array([*offsets, len(triples)], pa.int32()), members)
                    places = [batch.column(c).take(pa.array(of_row)) for c in PLACE]
                    yield pa.RecordBatch.from_arrays([*places, entries, pa.array(errors, pa.string())], schema.names)
                at = to

    parsed = pieces.select(*PLACE, "root_tag", "root", "content").mapInArrow(parse, schema)
    rootless = roots.where("root_tag = ''").select("source_path", "source_filename", F.lit("no root element").alias("error"))
    bad = faults.unionByName(rootless).select(
        "source_path", "source_filename", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row"),
        F.lit(None).cast(ENTRIES).alias("entries"), "error",
    )
    return parsed.unionByName(bad)


def spread_tasks(spark: SparkSession) -> int:
    """Tasks to spread whole files over: a few per core."""
    return max(4 * spark.sparkContext.defaultParallelism, 1)


# -- Parquet -----------------------------------------------------------------------------------


def _column_entries(field: T.StructField, col: Column, prefix: str = "") -> list[Column]:
    """One entry per leaf: nested structs are unfolded when the plan is built."""
    key = f"{prefix}_{field.name}" if prefix else field.name
    dtype = field.dataType
    if isinstance(dtype, T.StructType):
        return [
            leaf
            for inner in dtype
            for leaf in _column_entries(inner, col[inner.name], key)
        ]
    if isinstance(dtype, T.StringType):
        value, kind = col, "S"
    elif isinstance(dtype, T.BooleanType):
        value, kind = col.cast("string"), "B"
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        value, kind = F.when(~F.isnan(col), number_text(col.cast("double"))), "N"
    elif isinstance(dtype, T.NumericType):
        value, kind = col.cast("string"), "N"
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        exact = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        value, kind = F.regexp_replace(exact, r"\.000000$", ""), "T"
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        value, kind = F.to_json(col), "A"
    else:
        value, kind = col.cast("string"), "T"
    return [
        E.entry(F.lit(key), value, F.when(value.isNull(), F.lit("V")).otherwise(F.lit(kind)))
    ]


def row_entries(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Entries of the typed columns of a frame."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    return F.array(*[e for f in fields for e in _column_entries(f, F.col(f"`{f.name}`"))])


def parquet_schemas(files: DataFrame) -> DataFrame:
    """``(source_path, shape)`` where files of the same columns share a shape."""

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            found = []
            for path in batch["source_path"]:
                try:
                    with open_file(path) as file:
                        schema = pq.read_schema(file).remove_metadata()
                    found.append(schema.to_string(show_field_metadata=False))
                except Exception:  # not a Parquet file: reported, not fatal
                    found.append(None)
            yield pd.DataFrame({"source_path": batch["source_path"], "shape": found})

    return files.select("source_path").mapInPandas(shapes, "source_path string, shape string")


def read_parquet_group(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files of one shape as ``entries``."""
    rows = spark.read.parquet(*paths)
    # places are taken at the scan, before rows are spread over more tasks
    placed = rows.select("*", *file_place(F.monotonically_increasing_id()))
    return spread(placed).select(*PLACE, row_entries(rows).alias("entries"))

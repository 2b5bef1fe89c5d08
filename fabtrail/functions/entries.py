"""Ordered raw fields of a record: ``array<struct<key, value, kind>>``.

A map would lose the source order and the JSON kind of a value, and both decide results
(the last of two columns for one field wins; only string values enter a built message).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fabtrail.functions.text import let
from fabtrail.schema import ENTRIES

def entry(key: Column, value: Column, kind: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"), kind.alias("kind"))


def text_entry(key: Column, value: Column) -> Column:
    return entry(key, value, F.when(value.isNull(), F.lit("V")).otherwise(F.lit("S")))


def empty_entries() -> Column:
    return F.array().cast(ENTRIES)


def _kind_of(variant: Column) -> Column:
    shape = F.schema_of_variant(variant)
    return (
        F.when(variant.isNull() | (shape == "VOID"), F.lit("V"))
        .when(shape == "STRING", F.lit("S"))
        .when(shape == "BOOLEAN", F.lit("B"))
        .when(shape.startswith("OBJECT"), F.lit("O"))
        .when(shape.startswith("ARRAY"), F.lit("A"))
        .otherwise(F.lit("N"))
    )


def object_entries(json: Column) -> Column:
    """Members of one JSON object in source order; null for anything else."""
    texts = F.map_entries(F.from_json(json, "map<string,string>"))
    kinds = F.map_values(F.from_json(json, "map<string,variant>"))
    # bound once: inside the inner function it would be parsed again per member
    return let(
        kinds,
        lambda found: F.transform(
            texts, lambda e, i: entry(e["key"], e["value"], _kind_of(F.get(found, i)))
        ),
    )


def _braces(entries: Column) -> Column:
    """Opening braces in the objects among the entries: at least as many as they are deep."""
    opening = lambda v: F.length(v) - F.length(F.replace(v, F.lit("{"), F.lit("")))
    return F.aggregate(
        entries, F.lit(0), lambda n, e: n + F.when(e["kind"] == "O", opening(e["value"])).otherwise(0)
    )


def unfold(entries: Column) -> Column:
    """Replace nested objects by their members, however deep, keys joined with ``_``."""

    def members(parent: Column) -> Column:
        return F.transform(
            object_entries(parent["value"]),
            lambda e: entry(F.concat_ws("_", parent["key"], e["key"]), e["value"], e["kind"]),
        )

    def opened(found: Column) -> Column:
        one_level = F.transform(
            found, lambda e: F.when(e["kind"] == "O", members(e)).otherwise(F.array(e))
        )
        return F.when(F.exists(found, lambda e: e["kind"] == "O"), F.flatten(one_level)).otherwise(found)

    def all_levels(found: Column) -> Column:
        levels = F.sequence(F.lit(1), _braces(found))
        return F.when(
            F.exists(found, lambda e: e["kind"] == "O"),
            F.aggregate(levels, found.cast(ENTRIES), lambda done, _: opened(done).cast(ENTRIES)),
        ).otherwise(found)

    return let(entries, all_levels)


def keys(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["key"])


def dedupe(entries: Column) -> Column:
    """One entry per key: the place of the first, the value of the last."""

    def last(found: Column, names: Column) -> Column:
        return F.transform(
            names, lambda k: F.element_at(F.filter(found, lambda e: e["key"] == k), -1)
        )

    def unique(found: Column) -> Column:
        return let(
            F.array_distinct(keys(found)),
            lambda names: F.when(F.size(names) < F.size(found), last(found, names)).otherwise(found),
        )

    return let(entries, unique)


def json_entries(json: Column) -> Column:
    """Unfolded, duplicate-free entries of a JSON object."""
    return dedupe(unfold(object_entries(json)))


def as_map(entries: Column) -> Column:
    """Key to value; the entries must be duplicate-free."""
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["value"])))


def as_text(entry_col: Column) -> Column:
    """Value as a string field keeps it."""
    return let(
        entry_col,
        lambda e: F.when(e["kind"] == "B", F.initcap(e["value"])).otherwise(e["value"]),
    )

"""Column helpers over text: trimming, casting, capturing, rendering as JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# characters a string strip removes
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# line ends a text reader does not know, but a line splitter does
EXTRA_LINE_ENDS = "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# never inside a line (it ends one), so it can part captured groups
_GROUP_SEP = "\x1e"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(col: Column, body) -> Column:
    """Like :func:`let`, but a plain column is used as it is.

    Every function that mentions its argument more than once goes through this: nested calls
    would otherwise multiply the expression, and with it planning and evaluation.
    """
    return body(col) if re.fullmatch(r"Column<'[\w.\[\]`]+'>", str(col)) else let(col, body)


def strip(col: Column) -> Column:
    """Remove all leading and trailing whitespace."""
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    return once(col, lambda c: F.when(strip(c) != "", c))


def empty_to_null(col: Column) -> Column:
    return once(col, lambda c: F.when(c != "", c))


def first_text(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[empty_to_null(c) for c in cols])


def split_lines(content: Column) -> Column:
    return F.split(content, LINE_END)


def to_number(col: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""

    def read(text: Column) -> Column:
        plain = text.rlike(
            r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$"
        )
        special = text.rlike(r"(?i)^[+-]?(?:inf|infinity|nan)$")
        digits = F.regexp_replace(text, "_", "").try_cast("double")
        return F.when(plain, digits).when(special, text.try_cast("double"))

    return once(strip(col), read)


def capture(col: Column, pattern: str, groups: int, *, at_start: bool = False) -> Column:
    """All groups of the first match in one pass of the regex, as an array of ``groups`` strings.

    Groups that took no part are empty strings; without a match the result is null.
    The value must be a single line.
    """
    lead = "^" if at_start else "^.*?"
    keep = _GROUP_SEP.join(f"${i}" for i in range(1, groups + 1))
    # the marker in front tells a match from an unchanged line
    found = F.regexp_replace(col, f"{lead}(?:{pattern}).*$", f"{_GROUP_SEP}{keep}")
    return let(
        F.split(found, _GROUP_SEP),
        lambda parts: F.when(F.size(parts) == groups + 1, F.slice(parts, 2, groups)),
    )


def group(captured: Column, number: int) -> Column:
    """Group ``number`` (from 1) of a capture; null when it took no part or is empty."""
    return empty_to_null(F.get(captured, F.lit(number - 1)))


def ellipsis(col: Column, width: int) -> Column:

    def cut(text: Column) -> Column:
        short = F.concat(F.left(text, F.lit(width)), F.lit("…"))
        return F.when(F.length(text) > width, short).otherwise(text)

    return once(col, cut)


def sanitize(col: Column, max_length: int = 1500) -> Column:
    """Drop control characters, then keep at most ``max_length`` characters."""
    return F.left(F.regexp_replace(col, r"[\x00-\x1F\x7F]", ""), F.lit(max_length))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column, default: str = "") -> Column:
    """Lower-cased part after the last dot."""

    def after_dot(n: Column) -> Column:
        last = F.lower(F.substring_index(n, ".", -1))
        return F.when(F.contains(n, F.lit(".")), last).otherwise(F.lit(default))

    return once(name, after_dot)


def stem(name: Column) -> Column:
    """Name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def display_time(ts: Column, tool: Column, event: Column) -> Column:
    """``[ts] tool — event`` with a long event cut at 80 characters."""
    return F.concat(F.lit("["), ts, F.lit("] "), tool, F.lit(" — "), ellipsis(event, 80))


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


# -- numbers as text -------------------------------------------------------------


def number_text(value: Column) -> Column:
    """A double in shortest form: plain between 1e-4 and 1e16, else with an exponent."""
    return once(value, _number_text)


def _number_text(value: Column) -> Column:
    def shortest(text: Column) -> Column:
        # the usual text may have a digit too many; the fewest that read back the same do
        short, middle = F.format_string("%.15e", value), F.format_string("%.16e", value)
        return (
            F.when(F.length(text) < 18, text)
            .when(short.try_cast("double") == value, short)
            .when(middle.try_cast("double") == value, middle)
            .otherwise(text)
        )

    def plain(text: Column, scale: int) -> Column:
        digits = F.regexp_replace(text.try_cast(f"decimal(38,{scale})").cast("string"), "0+$", "")
        return F.regexp_replace(digits, r"\.$", ".0")

    def shown(text: Column) -> Column:
        size = F.abs(value)
        parts = F.split(F.lower(text), "e")
        mantissa = F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(0)), "0+$", ""), r"\.$", "")
        power = F.get(parts, F.lit(1)).try_cast("int")
        exponent = F.concat(
            mantissa,
            F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
            F.lpad(F.abs(power).cast("string"), 2, "0"),
        )
        return (
            F.when(~F.lower(text).contains("e"), text)
            .when((size >= 1e-3) & (size < 1e16), plain(text, 20))
            .when((size >= 1e-4) & (size < 1e-3), plain(text, 30))
            .otherwise(exponent)
        )

    return F.when(value == 0, value.cast("string")).otherwise(
        let(let(value.cast("string"), shortest), shown)
    )


# -- JSON text ---------------------------------------------------------------------


def json_string(col: Column) -> Column:
    """A quoted and escaped JSON string; null stays null."""
    # null gives null, not the text "null"
    return once(
        F.to_json(F.array(col)),
        lambda quoted: F.when(
            quoted != "[null]", F.substring(quoted, F.lit(2), F.length(quoted) - 2)
        ),
    )


def json_value(entry: Column) -> Column:
    """The value of an entry as JSON text."""
    return F.when(entry["value"].isNull(), F.lit("null")).when(
        entry["kind"].isin("S", "T"), json_string(entry["value"])
    ).otherwise(entry["value"])


def json_members(entries: Column) -> Column:
    """Entries as ``"key": value`` texts."""
    return F.transform(
        entries, lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_value(e))
    )


def json_object(members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}"))


def typed_members(fields: dict[str, tuple[Column, str]]) -> Column:
    """Members for the fields that are not null; ``kind`` is S for text and N for numbers."""
    return F.array_compact(
        F.array(
            *[
                F.concat(
                    F.lit(f'"{name}": '), json_string(col) if kind == "S" else col.cast("string")
                )
                for name, (col, kind) in fields.items()
            ]
        )
    )


# -- bytes -------------------------------------------------------------------------


def latin(content: Column) -> Column:
    """Bytes as text, one character per byte."""
    return F.decode(content, "ISO-8859-1")


def le_u32(content: Column, position: Column) -> Column:
    """Little-endian unsigned 32-bit number at a 1-based byte position."""
    digits = F.hex(F.substring(content, position, F.lit(4)))
    swapped = F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("long")


def hex_bytes(content: Column) -> Column:
    """Bytes as two-digit lower-case hex separated by blanks."""
    return F.rtrim(F.regexp_replace(F.lower(F.hex(content)), "(..)", "$1 "))


def ascii_gutter(content: Column) -> Column:
    """Bytes as text with a dot for everything not printable."""
    return F.regexp_replace(latin(content), r"[^\x20-\x7e]", ".")


def hex_dump_line(offset: Column, chunk: Column) -> Column:
    """``offset  hex bytes  |text|`` for one chunk of at most 16 bytes."""
    return F.concat(
        F.lpad(F.lower(F.hex(offset)), 8, "0"),
        F.lit("  "),
        F.rpad(hex_bytes(chunk), 48, " "),
        F.lit("  |"),
        ascii_gutter(chunk),
        F.lit("|"),
    )


def printable_strings(content: Column, first: int = 50) -> Column:
    """The first runs of at least four printable ASCII characters."""
    return F.slice(F.regexp_extract_all(latin(content), F.lit(r"([\x20-\x7e]{4,})"), F.lit(1)), 1, first)

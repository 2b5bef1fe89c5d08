"""Free-form time texts to ISO text and to a timestamp column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fabtrail.functions.text import capture, group, let, strip

_ISO = (
    r"(\d{4}-\d{2}-\d{2})(?:[T ]+(\d{2}:\d{2})(?::(\d{2}))?(?:[.,](\d{1,9}))?"
    r"\s*(Z|z|[+-]\d{2}:?\d{2}|UTC|GMT)?)?$"
)

# dates as they are written: (shape, datetime pattern); month comes before day as in US dates
_DATES = [
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{1,2} [A-Z][a-z]{2},? \d{4}", "d MMM[,] yyyy"),
    (r"[A-Z][a-z]{2} \d{1,2},? \d{4}", "MMM d[,] yyyy"),
]
_SHAPES = [
    *[(rf"^{shape}(?: \d{{1,2}}:\d{{2}}(?::\d{{2}})?)?$", f"{pattern}[ H:mm[:ss]]") for shape, pattern in _DATES],
    *[(rf"^{shape} \d{{1,2}}:\d{{2}}(?::\d{{2}})? [AP]M$", f"{pattern} h:mm[:ss] a") for shape, pattern in _DATES],
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{14}$", "yyyyMMddHHmmss"),
    (r"^\d{8}T\d{6}$", "yyyyMMdd'T'HHmmss"),
    (r"^[A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2} \d{4}$", "MMM d HH:mm:ss yyyy"),
]
_WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,? "
_MONTH = r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?(?=[ ,-])"
# 1-Mar-2024 as 1 Mar 2024
_DASHED_NAME = r"(?<=\d)-(?=[A-Za-z]{3})|(?<=[A-Za-z])-(?=\d{4})"
_HALF_OF_DAY = r"(?<=\d) ?([AP])\.?m\.?$"
_NO_YEAR = r"^[A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2}$"
_NO_DATE = r"^\d{1,2}:\d{2}:\d{2}$"
# an offset behind a time of day
_ZONE = r"(?i)(?<=:\d{2}|m)\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2})$"


def _wall_clock(text: Column, ingest_ts: Column) -> Column:
    """Timestamp of a text in one of the listed shapes; a missing year or date is the run's."""

    def read(squeezed: Column) -> Column:
        year = F.concat(F.substring(ingest_ts, 1, 4), F.lit(" "))
        day = F.concat(F.substring(ingest_ts, 1, 10), F.lit(" "))
        hit = F.when(
            squeezed.rlike(_NO_YEAR),
            F.try_to_timestamp(F.concat(year, squeezed), F.lit("yyyy MMM d HH:mm:ss")),
        ).when(
            squeezed.rlike(_NO_DATE),
            F.try_to_timestamp(F.concat(day, squeezed), F.lit("yyyy-MM-dd H:mm:ss")),
        )
        for shape, pattern in _SHAPES:
            hit = hit.when(squeezed.rlike(shape), F.try_to_timestamp(squeezed, F.lit(pattern)))
        return hit.cast("timestamp_ntz")

    # initcap puts month names in the case the patterns want, and leaves digits alone
    bare = F.regexp_replace(F.regexp_replace(strip(text), _ZONE, ""), _DASHED_NAME, " ")
    squeezed = F.initcap(F.regexp_replace(bare, r"\s+", " "))
    squeezed = F.regexp_replace(F.regexp_replace(squeezed, _WEEKDAY, ""), _MONTH, "$1")
    return let(F.regexp_replace(squeezed, _HALF_OF_DAY, " $1M"), read)


def _iso_parts(parts: Column) -> tuple[Column, Column, Column]:
    """(wall clock to the second as ISO text, fraction, offset) of captured groups."""
    seconds = F.concat(
        group(parts, 1),
        F.lit("T"),
        F.coalesce(group(parts, 2), F.lit("00:00")),
        F.lit(":"),
        F.coalesce(group(parts, 3), F.lit("00")),
    )
    micros = F.rpad(F.left(group(parts, 4), F.lit(6)), 6, "0")
    fraction = F.when(micros != "000000", F.concat(F.lit("."), micros))
    return seconds, F.coalesce(fraction, F.lit("")), _offset(F.coalesce(group(parts, 5), F.lit("")))


def _offset(zone: Column) -> Column:
    """``+hh:mm`` of a zone as it is written; empty without one."""
    upper = F.upper(zone)
    return (
        F.when(upper == "", F.lit(""))
        .when(upper.isin("Z", "UTC", "GMT"), F.lit("+00:00"))
        .otherwise(F.concat(F.left(upper, F.lit(3)), F.lit(":"), F.right(upper, F.lit(2))))
    )


def _listed_offset(text: Column) -> Column:
    return _offset(F.regexp_extract(strip(text), _ZONE, 1))


def _to_utc(wall: Column, offset: Column) -> Column:
    sign = F.when(F.left(offset, F.lit(1)) == "-", F.lit(1)).otherwise(F.lit(-1))
    hours = F.substring(offset, 2, 2).try_cast("int")
    minutes = F.substring(offset, 5, 2).try_cast("int")
    shift = F.coalesce(sign * (hours * 60 + minutes), F.lit(0))
    return F.when(offset == "", wall).otherwise(F.timestamp_add("MINUTE", shift, wall))


def iso_timestamp(text: Column, ingest_ts: Column) -> Column:
    """ISO form of a time text; text that is no known time stays as it is, blank gives null."""

    def iso(parts: Column) -> Column:
        seconds, fraction, offset = _iso_parts(parts)
        known = seconds.try_cast("timestamp_ntz").isNotNull()
        return F.when(known, F.concat(seconds, fraction, offset))

    def read(raw: Column) -> Column:
        wall = F.date_format(_wall_clock(raw, ingest_ts), "yyyy-MM-dd'T'HH:mm:ss")
        listed = F.concat(wall, _listed_offset(raw))
        parts = capture(strip(raw), _ISO, 5, at_start=True)
        return F.when(raw != "", F.coalesce(let(parts, iso), listed, raw))

    return let(text, read)


def event_time(text: Column, ingest_ts: Column) -> Column:
    """Time text as a zone-less timestamp: UTC where the text has an offset, else wall clock."""

    def iso(parts: Column) -> Column:
        seconds, fraction, offset = _iso_parts(parts)
        wall = F.concat(seconds, fraction).try_cast("timestamp_ntz")
        return _to_utc(wall, offset)

    parts = capture(strip(text), _ISO, 5, at_start=True)
    listed = _to_utc(_wall_clock(text, ingest_ts), _listed_offset(text))
    return F.coalesce(let(parts, iso), listed)

"""The rule tables as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fabtrail import schema as S
from fabtrail.functions.text import let, once, strip


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(mapping), key)


FIELD_OF_ALIAS: dict[str, str] = {}
for _field, _names in S.ALIASES.items():
    for _name in _names:
        FIELD_OF_ALIAS.setdefault(_name, _field)


def severity_of(raw: Column) -> Column:
    """Canonical severity of a level word; unknown words are INFO."""
    return F.coalesce(_lookup(S.SEVERITY_OF_WORD, F.lower(strip(raw))), F.lit("INFO"))


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in S.SEVERITY_RANK.items() for x in pair])
    return F.try_element_at(ranks, severity)


def is_fault(severity: Column) -> Column:
    return severity.isin(S.FAULT_SEVERITIES)


def syslog_severity(priority: Column) -> Column:
    """Severity of a syslog priority number; INFO without one."""
    code = F.pmod(priority.try_cast("decimal(38,0)"), F.lit(8)).cast("int")
    levels = F.array(*[F.lit(s) for s in S.SYSLOG_SEVERITY])
    return F.coalesce(F.get(levels, code), F.lit("INFO"))


def parameter_name_of(raw: Column) -> Column:
    """Canonical parameter name, else the lower-cased name."""

    def canonical(name: Column) -> Column:
        hit = F.when(name.isNull(), F.lit(None).cast("string"))
        for prefix, field in S.PARAMETER_PREFIXES.items():
            starts = name.rlike(f"^{prefix}") if "*" in prefix else name.startswith(prefix)
            hit = hit.when(starts, F.lit(field))
        return hit.otherwise(name)

    return once(F.lower(strip(raw)), canonical)


def log_type_of(text: Column) -> Column:
    """First log type whose words occur in the text; ``info`` if none does."""

    def classify(lowered: Column) -> Column:
        hit = F.when(F.lit(False), F.lit(""))
        for log_type, pattern in S.LOG_TYPE_PATTERNS.items():
            hit = hit.when(lowered.rlike(pattern), F.lit(log_type))
        return hit.otherwise(F.lit("info"))

    return once(F.lower(text), classify)


def promoted_severity(severity: Column, message: Column) -> Column:
    """Raise INFO by the first listed whole word found in the message."""
    any_word = "|".join(S.PROMOTION_WORDS)

    def raised(lowered: Column) -> Column:
        # one test first: most lines hold none of the words
        hit = F.when(~lowered.rlike(rf"(?U)\b(?:{any_word})\b"), F.lit("INFO"))
        for word, level in S.PROMOTION_WORDS.items():
            hit = hit.when(lowered.rlike(rf"(?U)\b{word}\b"), F.lit(level))
        return hit.otherwise(F.lit("INFO"))

    return once(
        severity, lambda s: F.when(s == "INFO", let(F.lower(message), raised)).otherwise(s)
    )


def alias_field(key: Column) -> Column:
    """Canonical field a column name stands for, null if none."""
    return _lookup(FIELD_OF_ALIAS, F.lower(strip(key)))


def target_field(key: Column, mapping: Column | None = None) -> Column:
    """Canonical field of a column: timestamp, tool, severity and event by either rule first,
    then the header mapping, then the names."""
    alias = alias_field(key)
    if mapping is None:
        return alias
    mapped = F.coalesce(
        F.try_element_at(mapping, key), F.try_element_at(mapping, F.lower(strip(key)))
    )

    def pick(both: Column) -> Column:
        leading = F.when(F.lit(False), F.lit(""))
        for field in S.LEADING_FIELDS:
            leading = leading.when((both["m"] == field) | (both["a"] == field), F.lit(field))
        return leading.otherwise(F.coalesce(both["m"], both["a"]))

    return let(F.struct(mapped.alias("m"), alias.alias("a")), pick)


# -- fallbacks over event text -------------------------------------------------------

PARAMETER_IN_TEXT = (
    r"(?iu)(Pressure|Temperature|Flow|Voltage|Current|Speed|RPM|Power|Step|Humidity)"
    r"\s*[=:]\s*(-?\d+(?:\.\d+)?)\s*(Torr|RPM|C|%|V|A|W)?"
)
TOOL_IN_TEXT = r"\b([A-Z]{2,6}[-_]?\d{2,6})\b"
WAFER_IN_TEXT = r"(?i)(?:wafer|lot|substrate)[_\s]*[=:#]?\s*([A-Z0-9_\-]+)"
#: wafer id in its full shape, for callers that want no ids out of plain words
STRICT_WAFER_IN_TEXT = r"(?i)\b(?:wafer|lot|substrate)[_\s]*[=:#]?\s*([A-Z]{2,}[0-9]+[-_][A-Z]?\d+)"
STEP_IN_TEXT = r"(?i)(?:step|stage|phase)\s*(?:no|num|number)?\s*[=:#]?\s*(\d+)"

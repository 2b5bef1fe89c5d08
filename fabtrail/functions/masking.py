"""Masking of variable parts of a message before template mining."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: (pattern, name), applied in this order
MASKS = [
    (r"\b[a-zA-Z0-9_]+-[a-zA-Z0-9_]+-[a-zA-Z0-9_]+\b", "EQUIPMENT_ID"),
    (r"(?<![A-Za-z0-9])[\-\+]?\d+\.\d+(?![A-Za-z0-9])", "FLOAT"),
    (r"(?<![A-Za-z0-9])[\-\+]?\d+(?![A-Za-z0-9.])", "NUM"),
    (r"0[xX][0-9a-fA-F]+", "HEX"),
    (r"(?<=[:=] )[^\s,;]+", "VAL"),
]
WILDCARD = "<*>"


def mask_message(message: Column) -> Column:
    for pattern, name in MASKS:
        message = F.regexp_replace(message, pattern, f"<:{name}:>")
    return message


def template_tokens(masked: Column) -> Column:
    """Tokens of a masked message: blanks and underscores part them."""
    return F.filter(
        F.split(F.btrim(F.regexp_replace(masked, "_", " ")), r"(?U)\s+"), lambda t: t != ""
    )

"""Small text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet that ASCII-only case folding touches.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Fold only A-Z, the folding the artifact text filter is defined with.

    On pure ASCII text this is the ordinary lower case, which is far cheaper than
    the character map.
    """
    pure = F.length(col) == F.octet_length(col)
    return F.when(pure, F.lower(col)).otherwise(F.translate(col, ASCII_UPPER, ASCII_LOWER))


def collapse_whitespace(col: Column, max_chars: int | None = None) -> Column:
    """Collapse whitespace runs to one blank; whole text unless a cap is asked for."""
    out = F.btrim(F.regexp_replace(col, r"(?U)[\s\x1c-\x1f]+", " "))
    return out if max_chars is None else F.substring(out, 1, max_chars)


def pad_number(col: Column, width: int) -> Column:
    """Zero-pad an integer to at least ``width`` digits, never truncating."""
    text = col.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def label_slug(label: Column) -> Column:
    """Dataset label as used inside batch ids; blank labels become ``dataset``."""
    base = F.coalesce(blank_to_null(label), F.lit("dataset"))
    slug = F.btrim(F.regexp_replace(base, "[^A-Za-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(blank_to_null(slug), F.lit("dataset"))


def quoted(col: Column) -> Column:
    """Single-quoted spelling of a string as it appears in warning texts."""
    plain = F.concat(F.lit("'"), F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("'"))
    with_quote = F.concat(F.lit('"'), F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'))
    return F.when(F.contains(col, F.lit("'")) & ~F.contains(col, F.lit('"')), with_quote).otherwise(plain)


def float_text(col: Column) -> Column:
    """Shortest decimal spelling: positional from 1e-4 up to 1e16, else ``1e-05`` style."""
    raw = col.cast("string")
    size = F.abs(col)
    positional = F.rtrim(raw.cast("decimal(38,21)").cast("string"), F.lit("0"))
    positional = F.when(positional.endswith("."), F.concat(positional, F.lit("0"))).otherwise(positional)
    mantissa = F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(raw, F.lit("E"), F.lit(2))
    digits = F.regexp_replace(power, "^-", "")
    exponential = F.concat(
        mantissa,
        F.when(power.startswith("-"), F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits),
    )
    return (
        F.when(~F.contains(raw, F.lit("E")), raw)
        .when((size >= 1e-4) & (size < 1e16), positional)
        .otherwise(exponential)
    )


def bracket_list(items: Column) -> Column:
    """``[a, b]`` from an array of already spelled items."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def like_needle(needle: str) -> str:
    """Pattern for the artifact text filter: ``%`` and ``_`` stay wildcards, backslash is literal."""
    return "%" + needle.casefold().replace("\\", "\\\\") + "%"

"""Scalar text helpers as Spark ``Column`` builders (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space JavaScript's String.prototype.trim removes
# (ASCII space/tab/CR/LF/VT/FF, every Unicode space separator, line and
# paragraph separators, and the byte-order mark U+FEFF).
JS_SPACE_CLASS = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}]"
_TRIM_PATTERN = rf"^{JS_SPACE_CLASS}+|{JS_SPACE_CLASS}+$"

# The UUID shape accepted for ids and cursor ids.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """F2 helper: trim like JavaScript (Spark ``trim`` only strips spaces)."""
    return F.regexp_replace(col_(c), _TRIM_PATTERN, "")


def trim_to_null(c) -> Column:
    """trimmed text, empty string becomes null."""
    return F.nullif(js_trim(c), F.lit(""))


def trim_lower(c) -> Column:
    """trimmed, lower-cased; empty becomes null."""
    return F.lower(trim_to_null(c))


def split_tags(c) -> Column:
    """split on ';', trim every piece, drop empty pieces."""
    parts = F.transform(F.split(col_(c), ";"), lambda x: js_trim(x))
    return F.filter(parts, lambda x: x != F.lit(""))


def digits_only(c) -> Column:
    """the digits of a text (null-safe: null counts as '')."""
    return F.regexp_replace(F.coalesce(col_(c), F.lit("")), r"\D", "")


def normalize_header(c) -> Column:
    """strip BOM, trim, lower-case, runs of white space or '-' become '_'."""
    no_bom = F.regexp_replace(col_(c), "\\x{FEFF}", "")
    return F.regexp_replace(F.lower(js_trim(no_bom)), r"[\s-]+", "_")


def initials(first, last) -> Column:
    """first letters of first and last name, upper-cased."""
    return F.upper(F.concat(F.left(F.coalesce(col_(first), F.lit("")), F.lit(1)),
                            F.left(F.coalesce(col_(last), F.lit("")), F.lit(1))))


def stable_bucket(c, slots: int = 8) -> Column:
    """31-polynomial hash of the lower-cased text modulo 2^32, then modulo ``slots``."""
    chars = F.split(F.lower(col_(c)), "")
    h = F.aggregate(
        F.filter(chars, lambda ch: ch != F.lit("")),
        F.lit(0).cast("long"),
        lambda acc, ch: (acc * 31 + F.ascii(ch).cast("long")) % F.lit(4294967296),
    )
    return (h % slots).cast("int")


def slug(c) -> Column:
    """lower-case, keep only a-z."""
    return F.regexp_replace(F.lower(col_(c)), "[^a-z]", "")


def pad_left(c, width: int = 4, fill: str = "0") -> Column:
    """left-pad the text form to ``width``."""
    return F.lpad(col_(c).cast("string"), width, fill)


def truncate_text(c, n: int) -> Column:
    """the first ``n`` characters."""
    return F.substring(col_(c), 1, n)


def error_filename(c) -> Column:
    """'x.csv' → 'x-errors.csv' (case-insensitive suffix); otherwise append."""
    base = F.regexp_replace(col_(c), r"(?i)\.csv$", "")
    return F.concat(base, F.lit("-errors.csv"))


def is_uuid(c) -> Column:
    """the text is a UUID."""
    return col_(c).rlike(UUID_PATTERN)


def contains_literal(c, term: str) -> Column:
    """P5: substring test where % _ and \\ are ordinary characters."""
    return F.contains(col_(c), F.lit(term))

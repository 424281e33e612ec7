"""Field validators (P14, P15) as boolean Spark Columns.

Fixed values: the phone shape, its digit bounds, and the documented e-mail
pattern (one '@', dot-atom local part of at most 64 characters, a dotted
domain of letter/digit/hyphen labels of at most 63 characters and an
alphabetic top-level label of at least 2 letters, 254 characters in all).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolodeck.functions.text import col_

PHONE_SHAPE = r"^\+?[\d\s().-]+$"
PHONE_MIN_DIGITS, PHONE_MAX_DIGITS = 7, 15
EMAIL_MAX = 254
LOCAL_MAX = 64
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
EMAIL_PATTERN = (
    rf"^{_ATOM}(\.{_ATOM})*@([A-Za-z0-9]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.)+[A-Za-z]{{2,63}}$"
)


def digit_count(c) -> Column:
    return F.length(F.regexp_replace(col_(c), r"\D", ""))


def is_phone(c) -> Column:
    """Phone characters only (optional leading +) and 7–15 digits."""
    x = col_(c)
    n = digit_count(x)
    return x.rlike(PHONE_SHAPE) & (n >= PHONE_MIN_DIGITS) & (n <= PHONE_MAX_DIGITS)


def is_email(c) -> Column:
    """Syntactic e-mail check with the length limits."""
    x = col_(c)
    local = F.substring_index(x, "@", 1)
    return x.rlike(EMAIL_PATTERN) & (F.length(x) <= EMAIL_MAX) & (F.length(local) <= LOCAL_MAX)

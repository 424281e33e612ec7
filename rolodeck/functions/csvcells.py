"""CSV cell and line helpers (F15, F16) as Spark Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolodeck.functions.text import col_

# A cell is a formula risk when it starts with = @ TAB CR, or
# with + / - not followed only by phone characters (digits, space ( ) . -).
FORMULA_START = r"^[=@\t\r]"
SIGNED_NOT_PHONE = r"^[+-](?![\d\s().-]*$)"


def csv_safe(c) -> Column:
    """prefix ``'`` to cells a spreadsheet would run as a formula."""
    x = col_(c)
    risky = x.rlike(FORMULA_START) | x.rlike(SIGNED_NOT_PHONE)
    return F.when(risky, F.concat(F.lit("'"), x)).otherwise(x)


def csv_quote(c) -> Column:
    """F16: quote a cell holding a quote, comma, CR or LF (quotes doubled)."""
    x = col_(c)
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_line(cells: list) -> Column:
    """F16: one CSV line from cell columns (formula-safe, quoted, no line end)."""
    return F.concat_ws(",", *[csv_quote(csv_safe(F.coalesce(col_(c), F.lit("")))) for c in cells])


def csv_line_from_array(arr) -> Column:
    """F16 over an array<string> column."""
    return F.array_join(F.transform(col_(arr), lambda x: csv_quote(csv_safe(F.coalesce(x, F.lit(""))))), ",")

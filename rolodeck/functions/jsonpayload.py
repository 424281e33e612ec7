"""JSON payload helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolodeck.functions.text import col_


def json_object(c) -> Column:
    """a struct/map as JSON text with null fields kept (as JSON.stringify does)."""
    return F.to_json(col_(c), {"ignoreNullFields": "false"})


def json_path(c, path: str) -> Column:
    """Read one value from a JSON payload (``$.a.b`` path)."""
    return F.get_json_object(col_(c), path)

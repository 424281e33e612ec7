"""human title and detail of an activity event, from its type and JSON payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolodeck.functions.text import col_

# Field labels and event titles.
LABELS = {
    "firstName": "First name", "lastName": "Last name", "email": "Email", "phone": "Phone", "company": "Company",
    "first_name": "First name", "last_name": "Last name",
}
PAYLOAD_T = "struct<bulk:boolean,tag:struct<id:string,name:string>,changes:map<string,struct<from:string,to:string>>>"
EMPTY = "(empty)"


def _show(v: Column) -> Column:
    return F.when(v.isNull() | (v == ""), F.lit(EMPTY)).otherwise(v)


def _label(k: Column) -> Column:
    expr = F.lit(None).cast("string")
    for key, label in LABELS.items():
        expr = F.when(k == key, F.lit(label)).otherwise(expr)
    return F.coalesce(expr, k)


def activity_title(type_col, payload_col) -> Column:
    t = col_(type_col)
    p = F.from_json(col_(payload_col), PAYLOAD_T)
    bulk = F.coalesce(p["bulk"], F.lit(False))
    return (
        F.when(t == "CONTACT_CREATED", "Contact created")
        .when(t == "CONTACT_UPDATED", "Contact updated")
        .when(t == "CONTACT_DELETED", F.when(bulk, "Moved to trash (bulk)").otherwise("Moved to trash"))
        .when(t == "CONTACT_RESTORED", "Restored from trash")
        .when(t == "TAG_ADDED", F.when(bulk, "Tag added (bulk)").otherwise("Tag added"))
        .when(t == "TAG_REMOVED", "Tag removed")
    )


def activity_detail(type_col, payload_col) -> Column:
    """The tag name for tag events; ``Field: from → to; …`` for updates (null
    when nothing changed); null otherwise."""
    t = col_(type_col)
    p = F.from_json(col_(payload_col), PAYLOAD_T)
    changes = F.coalesce(p["changes"], F.create_map().cast("map<string,struct<from:string,to:string>>"))
    text = F.array_join(
        F.transform(F.map_entries(changes), lambda e: F.concat(_label(e["key"]), F.lit(": "), _show(e["value"]["from"]),
                                                               F.lit(" → "), _show(e["value"]["to"]))), "; ")
    return (
        F.when(t.isin("TAG_ADDED", "TAG_REMOVED"), p["tag"]["name"])
        .when(t == "CONTACT_UPDATED", F.when(text != "", text))
    )

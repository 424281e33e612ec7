"""The rules of a contact's fields, as one column of errors.

Used by create (M1) and update (M2) commands alike: a rule is a condition on a
normalised column (trimmed to null, e-mail lower-cased) and the error that it
gives. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolodeck.functions.text import js_trim
from rolodeck.functions.validators import EMAIL_MAX, is_email, is_phone

# Limits, API names of the columns and messages.
NAME_MAX, COMPANY_MAX, TAG_MAX, TAGS_MAX = 100, 150, 50, 20
API_NAMES = {"first_name": "firstName", "last_name": "lastName", "email": "email", "phone": "phone", "company": "company"}
EMPTY = "{} should not be empty"
TOO_LONG = "{} must be shorter than or equal to {} characters"
NO_EMAIL = "email must be an email"
NO_PHONE = "phone must be 7-15 digits and may contain + ( ) - . and spaces"
TOO_MANY_TAGS = "tags must contain no more than {} elements"
TAG_TOO_LONG = "each value in tags must be shorter than or equal to {} characters"
TAG_COMMA = "tag names cannot contain commas"

NO_ERRORS = "array<struct<field:string,message:string>>"


def trimmed_tags(c: str) -> Column:
    """Tag names of a create command: trimmed, blank ones left out; no names for null."""
    return F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: js_trim(t)), lambda t: t != "")


def _longer(column: str, limit: int) -> tuple[Column, str, str]:
    return F.length(column) > limit, API_NAMES[column], TOO_LONG.format(API_NAMES[column], limit)


def field_errors(given: dict[str, Column] | None = None, tags: Column | None = None) -> Column:
    """array<struct<field, message>> over the columns first_name, last_name, email, phone, company.

    ``given``: which fields a command sets (an update); without it all are (a create). ``tags``: trimmed names.
    """
    rules = []
    for name in ("first_name", "last_name"):
        rules += [(name, F.col(name).isNull(), API_NAMES[name], EMPTY.format(API_NAMES[name])), (name, *_longer(name, NAME_MAX))]
    rules += [
        ("email", (F.length("email") <= EMAIL_MAX) & ~is_email("email"), "email", NO_EMAIL), ("email", *_longer("email", EMAIL_MAX)),
        ("phone", ~is_phone("phone"), "phone", NO_PHONE), ("company", *_longer("company", COMPANY_MAX)),
    ]
    checks = [(F.lit(True) if given is None else given[name]) & F.coalesce(broken, F.lit(False)) for name, broken, _, _ in rules]
    said = [(field, message) for _, _, field, message in rules]
    if tags is not None:
        checks += [F.size(tags) > TAGS_MAX, F.exists(tags, lambda t: F.length(t) > TAG_MAX), F.exists(tags, lambda t: F.contains(t, F.lit(",")))]
        said += [("tags", TOO_MANY_TAGS.format(TAGS_MAX)), ("tags", TAG_TOO_LONG.format(TAG_MAX)), ("tags", TAG_COMMA)]
    found = [F.when(c, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for c, (f, m) in zip(checks, said)]
    return F.array_compact(F.array(*found))


def errors_text(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ")

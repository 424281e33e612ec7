"""Contact table: stored generated columns (F1) and the public projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolodeck.functions.text import digits_only

# The 10 public columns of a contact, in API order, and their API names.
PUBLIC_COLUMNS = [
    ("id", "id"),
    ("first_name", "firstName"),
    ("last_name", "lastName"),
    ("email", "email"),
    ("phone", "phone"),
    ("company", "company"),
    ("version", "version"),
    ("created_at", "createdAt"),
    ("updated_at", "updatedAt"),
    ("deleted_at", "deletedAt"),
]


def generated_columns() -> dict:
    """the four stored columns every search and sort uses."""
    return {
        "name_sort": F.concat(F.lower("last_name"), F.lit(" "), F.lower("first_name")),
        "search_name": F.concat(F.lower("first_name"), F.lit(" "), F.lower("last_name")),
        "phone_digits": digits_only("phone"),
        "company_lower": F.lower(F.coalesce(F.col("company"), F.lit(""))),
    }


def with_generated_columns(df: DataFrame) -> DataFrame:
    """Materialise F1 at ingest, so searches read a plain column."""
    return df.withColumns(generated_columns())


def scan_contacts(contacts: DataFrame, keep_account: bool = True) -> DataFrame:
    """The public projection with API (camelCase) names; the scan reads only these columns."""
    cols = [F.col(src).alias(dst) for src, dst in PUBLIC_COLUMNS]
    if keep_account:
        cols = [F.col("account_id").alias("accountId")] + cols
    return contacts.select(*cols)


#: The column by which the rows of contacts and of their links are dealt over buckets, and the order within one.
BUCKETS = {"contacts": ("id", ["account_id", "created_at", "id"]), "contact_tags": ("contact_id", ["contact_id", "tag_id"])}


def write_bucketed(df: DataFrame, table: str, name: str, path: str, buckets: int) -> None:
    """Store contacts, or their links, as a catalog table ``name`` of so many buckets by contact id.

    Joins and semi joins of the two on the contact need no exchange of either
    side. An account of any size is spread over all buckets, and each file (one
    a bucket) is sorted by the account and the list keys, so Parquet min/max
    statistics let a tenant filter or a keyset seek skip row groups. No
    ``partitionBy(account_id)``: thousands of tiny tenants would mean thousands
    of tiny folders.
    """
    key, order = BUCKETS[table]
    (df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(*order).saveAsTable(name))


def read_bucketed(spark, table: str, name: str, path: str, schema: StructType, buckets: int) -> DataFrame:
    """The table that ``write_bucketed`` stored, entered into the catalog of this session where it is not."""
    if not spark.catalog.tableExists(name):
        key, order = BUCKETS[table]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (path '{path}') "
                  f"CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS")
    return spark.table(name)

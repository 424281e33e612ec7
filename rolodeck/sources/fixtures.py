"""The contact model derived from the driver's TPC-H-like tables.

The test tables carry no contacts, so the contact-data model is derived from
them with plain DataFrame operations (joins and grouped aggregates, so the
derivation grows with the data). The same derivation is written as SQL in
``rolodeck.plans.oracle_fixtures`` for the DuckDB cross-check.

Fixed values (must equal the oracle's): the clock ``AS_OF`` and the day shift
that moves the newest order date onto 2024-01-31.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolodeck.sources.contacts import with_generated_columns

# Fixed values
AS_OF = dt.datetime(2024, 1, 31, 12, 0, 0)
SHIFT_DAYS = 8218
UNTAGGED = (8, 5)  # contacts with id % 8 = 5 have no tag


def as_of_lit():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _shift(c):
    return c + F.make_dt_interval(F.lit(SHIFT_DAYS))


# schemas of the input tables already read in this process, keyed by path, size and modification time
_RAW_SCHEMAS: dict[tuple, StructType] = {}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; its schema is inferred once per file version and then passed to the reader."""
    path = f"{sf_dir}/{name}.parquet"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    st = fs.getFileStatus(p)
    key = (path, st.getLen(), st.getModificationTime())
    schema = _RAW_SCHEMAS.get(key)
    if schema is None:
        df = spark.read.parquet(path)
        _RAW_SCHEMAS[key] = df.schema
        return df
    return spark.read.schema(schema).parquet(path)


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with the stored generated columns (see FIXTURES.md §1)."""
    cust = raw(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    part = raw(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    orders = (
        raw(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.min_by("o_orderdate", "o_orderkey").alias("first_order"), F.max("o_orderdate").alias("last_order"))
    )
    base = cust.join(part, cust.c_custkey == part.p_partkey).join(orders, cust.c_custkey == orders.o_custkey)
    idc = F.col("c_custkey")
    first = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    last = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    n = F.lpad(F.floor(F.abs(F.col("c_acctbal"))).cast("bigint").cast("string"), 5, "0")
    phone = F.when(idc % 2 == 0, F.concat(F.lit("+1 (555) "), F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 2), F.lit("00"))).otherwise(
        F.concat(F.lit("1-555-"), F.substring(n, 1, 3), F.lit("."), F.substring(n, 4, 2), F.lit("00"))
    )
    updated = _shift(F.col("last_order"))
    df = base.select(
        idc.alias("id"),
        (F.col("c_nationkey") % 2).cast("int").alias("account_id"),
        first.alias("first_name"),
        last.alias("last_name"),
        F.when(idc % 13 == 3, F.lit(None).cast("string"))
        .otherwise(F.lower(F.concat_ws("", first, F.lit("."), last, F.lit("."), idc.cast("string"), F.lit("@"), F.col("c_mktsegment"), F.lit(".test"))))
        .alias("email"),
        F.when(idc % 7 == 3, F.lit(None).cast("string")).otherwise(phone).alias("phone"),
        F.when(idc % 10 == 4, F.lit(None).cast("string")).otherwise(F.concat_ws(" ", F.col("p_brand"), F.col("c_mktsegment"))).alias("company"),
        (1 + idc % 3).cast("int").alias("version"),
        _shift(F.col("first_order")).alias("created_at"),
        updated.alias("updated_at"),
        F.when(idc % 50 == 7, updated).alias("deleted_at"),
    )
    return with_generated_columns(df)


def _priority_digit():
    return F.substring(F.col("o_orderpriority"), 1, 1).cast("int")


def tags(spark: SparkSession, sf_dir: str, contacts_df: DataFrame | None = None) -> DataFrame:
    """One tag per (account, order priority) that occurs among the account's orders."""
    c = (contacts_df if contacts_df is not None else contacts(spark, sf_dir)).select("id", "account_id")
    o = raw(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate")
    return (
        o.join(c.hint("merge"), o.o_custkey == c.id)
        .groupBy("account_id", "o_orderpriority")
        .agg(_shift(F.min("o_orderdate")).alias("created_at"))
        .select(
            (F.col("account_id") * 10 + _priority_digit()).cast("int").alias("id"),
            "account_id",
            F.substring(F.col("o_orderpriority"), 3, 100).alias("name"),
            "created_at",
        )
    )


def contact_tags(spark: SparkSession, sf_dir: str, contacts_df: DataFrame | None = None) -> DataFrame:
    """Links: orders grouped by customer and priority (PK contact_id, tag_id), for all but the untagged contacts."""
    c = (contacts_df if contacts_df is not None else contacts(spark, sf_dir)).select("id", "account_id")
    o = raw(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate")
    c = c.filter(F.col("id") % UNTAGGED[0] != UNTAGGED[1])
    return (
        o.join(c.hint("merge"), o.o_custkey == c.id)
        .groupBy("id", "account_id", "o_orderpriority")
        .agg(_shift(F.min("o_orderdate")).alias("created_at"))
        .select(
            F.col("id").alias("contact_id"),
            (F.col("account_id") * 10 + _priority_digit()).cast("int").alias("tag_id"),
            "created_at",
        )
    )


def contact_activity(spark: SparkSession, sf_dir: str, contacts_df: DataFrame | None = None) -> DataFrame:
    c = (contacts_df if contacts_df is not None else contacts(spark, sf_dir)).select("id", "account_id")
    e = raw(spark, sf_dir, "events")
    et = F.col("event_type")
    typ = (
        F.when(et == "signup", "CONTACT_CREATED")
        .when(et == "click", "CONTACT_UPDATED")
        .when(et == "error", "CONTACT_DELETED")
        .when(et == "view", "TAG_ADDED")
        .when((et == "purchase") & (F.col("event_id") % 2 == 0), "CONTACT_RESTORED")
        .when(et == "purchase", "TAG_REMOVED")
    )
    return e.join(c.hint("merge"), e.user_id == c.id).select(
        F.col("event_id").alias("id"),
        "account_id",
        F.col("user_id").alias("contact_id"),
        typ.alias("type"),
        F.col("props").alias("payload"),
        F.col("ts").alias("created_at"),
    )


def import_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raw(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    mode = F.when(k % 3 == 0, "update").otherwise("create")
    status = F.when(k % 5 == 0, "failed").when(k % 5 == 1, "ready").otherwise("completed")
    total = (100 + k % 400).cast("int")
    errors = (k % 11).cast("int")
    created_at = as_of_lit() - F.make_dt_interval((k % 60).cast("int"))
    return s.select(
        k.alias("id"),
        (F.col("s_nationkey") % 2).cast("int").alias("account_id"),
        mode.alias("mode"),
        F.concat(F.lower(F.regexp_replace(F.col("s_name"), "#", "-")), F.lit(".csv")).alias("filename"),
        status.alias("status"),
        total.alias("total_rows"),
        (total - errors).cast("int").alias("valid_rows"),
        errors.alias("error_rows"),
        F.when(status == "completed", total).otherwise(0).cast("int").alias("processed_rows"),
        F.when(mode == "create", 80).otherwise(0).cast("int").alias("created_count"),
        F.when(mode == "update", 60).otherwise(0).cast("int").alias("updated_count"),
        (k % 7).cast("int").alias("unchanged_count"),
        created_at.alias("created_at"),
        # validation and import take a few seconds that grow with the file
        F.when(status != "failed", created_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (total / 50.0).cast("decimal(10,6)")))
        .alias("validated_at"),
        F.when(status == "completed", created_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (total / 20.0).cast("decimal(10,6)")))
        .alias("finished_at"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load-test request records (FIXTURES.md §4) derived from ``events``."""
    e = raw(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 97 == 0, 404).otherwise(200)
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("scenario"),
        F.pow(F.lit(2), F.col("user_id") % 5).cast("int").alias("clients"),
        status.cast("int").alias("status"),
        F.col("value").alias("latency_ms"),
        F.col("ts").alias("started_at"),
    )


@dataclass
class Model:
    """All derived tables of one scale."""

    contacts: DataFrame
    tags: DataFrame
    contact_tags: DataFrame
    activity: DataFrame
    import_jobs: DataFrame


def load_model(spark: SparkSession, sf_dir: str) -> Model:
    """The derived model as stored tables (built once per input fingerprint)."""
    from rolodeck.sources.store import stored_model

    return stored_model(spark, sf_dir)


def derive_model(spark: SparkSession, sf_dir: str, contacts_df: DataFrame | None = None) -> Model:
    """The derived model as lazy plans over the raw tables, and over ``contacts_df`` where the contacts are stored already."""
    c = contacts_df if contacts_df is not None else contacts(spark, sf_dir)
    return Model(
        contacts=c,
        tags=tags(spark, sf_dir, c),
        contact_tags=contact_tags(spark, sf_dir, c),
        activity=contact_activity(spark, sf_dir, c),
        import_jobs=import_jobs(spark, sf_dir),
    )

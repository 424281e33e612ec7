"""Tenant-level set operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolodeck.operators.ranking import top_n_per_group


def clone_tenant(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, src: int, dst: int,
                 id_offset: int, tag_offset: int) -> dict[str, DataFrame]:
    """Copy account ``src`` as account ``dst`` with new ids (old id +
    offset) and remap the link table through both id maps (equi joins)."""
    c = contacts.filter(F.col("account_id") == src)
    t = tags.filter(F.col("account_id") == src)
    cmap = c.select(F.col("id").alias("contact_id"), (F.col("id") + id_offset).alias("new_contact_id"))
    tmap = t.select(F.col("id").alias("tag_id"), (F.col("id") + tag_offset).alias("new_tag_id"))
    new_c = c.withColumn("id", F.col("id") + id_offset).withColumn("account_id", F.lit(dst).cast("int"))
    new_t = t.withColumn("id", (F.col("id") + tag_offset).cast("int")).withColumn("account_id", F.lit(dst).cast("int"))
    new_ct = contact_tags.join(cmap, "contact_id").join(tmap, "tag_id").select(
        F.col("new_contact_id").alias("contact_id"), F.col("new_tag_id").cast("int").alias("tag_id"), "created_at")
    return {"contacts": contacts.unionByName(new_c), "tags": tags.unionByName(new_t), "contact_tags": contact_tags.unionByName(new_ct)}


def recent_tag_history(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, n: int = 2000,
                       delay: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    """The tag links of each account's ``n`` newest contacts, with an
    event time of contact creation + ``delay``."""
    recent = top_n_per_group(contacts, ["account_id"], [F.col("created_at").desc(), F.col("id").desc()], n, key="id", order_needs=["created_at"])
    r = recent.select(F.col("id").alias("contact_id"), "created_at")
    t = tags.select(F.col("id").alias("tag_id"), "name")
    secs = int(delay.total_seconds())
    return contact_tags.select("contact_id", "tag_id").join(r, "contact_id").join(t, "tag_id").select(
        "contact_id", "tag_id", "name", (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(secs))).alias("event_at"))

"""Generators and simple sinks.

The seeded generator is parallel and deterministic: every value is a pick
driven by ``xxhash64(id, seed, k)``, so any slice of ids can be produced by
any task. Its vocabularies are built from syllable rules, so the values are
invented, not the reference's.
"""

from __future__ import annotations

import datetime as dt
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolodeck.functions.text import slug
from rolodeck.sources.contacts import with_generated_columns
from rolodeck.sources.fixtures import AS_OF

# Rule-built vocabularies (consonant-vowel syllables).
_ONSETS = ["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z"]
_VOWELS = ["a", "e", "i", "o", "u"]
SYLLABLES = [o + v for o, v in itertools.product(_ONSETS, _VOWELS)]  # 70 syllables
DOMAINS = ["mail.test", "example.test", "post.test", "inbox.test"]
COMPANY_SUFFIX = ["Works", "Labs", "Group", "Systems", "Partners", "Supply"]

RATE_NO_EMAIL, RATE_NO_PHONE, RATE_NO_COMPANY = 0.07, 0.15, 0.10
CREATED_SPAN_DAYS = 730


def hash01(*cols: Column) -> Column:
    """A deterministic uniform value in [0, 1) from the hash of the columns."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1_000_003)) / F.lit(1_000_003.0)).cast("double")


def _pick(options: list[str], u: Column) -> Column:
    arr = F.array(*[F.lit(x) for x in options])
    return F.get(arr, F.floor(u * len(options)).cast("int"))


def _word(idc: Column, seed: int, k: int, syllables: int) -> Column:
    parts = [_pick(SYLLABLES, hash01(idc, F.lit(seed), F.lit(k * 10 + j))) for j in range(syllables)]
    w = F.concat(*parts)
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))


def synthetic_contacts(spark: SparkSession, n: int, seed: int = 42, accounts: int = 2,
                       as_of: dt.datetime = AS_OF, first_id: int = 0) -> DataFrame:
    """``n`` contacts spread over ``accounts`` tenants; 7 % without e-mail,
    15 % without phone, 10 % without company; created uniformly over the 730
    days before ``as_of``; the id suffix keeps e-mails unique."""
    idc = F.col("id")
    u = lambda k: hash01(idc, F.lit(seed), F.lit(k))
    first = _word(idc, seed, 1, 2)
    last = _word(idc, seed, 2, 3)
    phone = F.format_string("(%d) %d-%04d", (200 + F.floor(u(10) * 799)).cast("int"), (200 + F.floor(u(11) * 799)).cast("int"),
                            F.floor(u(12) * 10000).cast("int"))
    created = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                                        F.floor(u(20) * CREATED_SPAN_DAYS * 86400).cast("decimal(18,0)"))
    df = spark.range(first_id, first_id + n).select(
        idc,
        (idc % accounts).cast("int").alias("account_id"),
        first.alias("first_name"),
        last.alias("last_name"),
        F.when(u(3) < RATE_NO_EMAIL, F.lit(None).cast("string")).otherwise(
            F.concat(slug(first), F.lit("."), slug(last), F.lit("."), idc.cast("string"), F.lit("@"), _pick(DOMAINS, u(4)))).alias("email"),
        F.when(u(5) < RATE_NO_PHONE, F.lit(None).cast("string")).otherwise(phone).alias("phone"),
        F.when(u(6) < RATE_NO_COMPANY, F.lit(None).cast("string")).otherwise(
            F.concat(_word(idc, seed, 7, 2), F.lit(" "), _pick(COMPANY_SUFFIX, u(8)))).alias("company"),
        F.lit(1).alias("version"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )
    return with_generated_columns(df)


def bernoulli_tags(contacts: DataFrame, tag_probs: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """Give each contact each tag with its probability. The tag list is a
    small parameter, so each contact row carries it as an array and keeps only
    its hits: no join and no pair that is not emitted."""
    arr = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in tag_probs])
    def drawn(t):  # uniform in [0, 1), from the first 32 bits of an MD5
        text = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), F.lit(":"), t["name"])
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / 2**32

    kept = F.filter(arr, lambda t: drawn(t) < t["p"])
    return contacts.select("account_id", F.col("id").alias("contact_id"), F.explode(kept).alias("t")).select(
        "account_id", "contact_id", F.col("t.name").alias("tag_name"),
        F.xxhash64(F.col("account_id"), F.lower(F.col("t.name"))).alias("tag_id"))


def rows_from_arrays(df: DataFrame, keep: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays → one row per position (``unnest(a, b, …)``)."""
    z = df.select(*keep, F.explode(F.arrays_zip(*[F.col(a) for a in arrays])).alias("_z"))
    return z.select(*keep, *[F.col(f"_z.{a}").alias(a) for a in arrays])


def append_activity(activity: DataFrame, path: str, batch: str) -> None:
    """Append a batch of events to a Parquet table partitioned by batch and
    day. A batch that is appended again replaces itself, so a retry adds nothing."""
    (activity.withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
     .write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}"))

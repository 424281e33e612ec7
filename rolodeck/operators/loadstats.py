"""Load-result rollups over request logs.

Input rows are single requests ``(scenario, clients, status, latency_ms,
started_at)``. Quantiles are exact nearest-rank values from counted
distributions (value, count), whose distinct values are ranked by
``rolodeck.operators.ranking``, so neither a huge step nor a frequent value
lands in one task; everything else is a grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolodeck.operators.ranking import position_within

# Fixed values
P99_LIMIT_MS = 2000
FAIL_LIMIT = 0.005
COMFORT_P99_MS = 500
KNEE_SHARE = 0.95
QUANTILES = {"p50": 0.5, "p97_5": 0.975, "p99": 0.99}


def js_round(x: Column) -> Column:
    """Math.round: halves toward +∞."""
    return F.floor(x + 0.5).cast("long")


def _ranked(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counted values (keys, value, _w, ...) with _pos, the position of a value's last row in its group, and _n, the group's rows.

    Whole numbers (milliseconds) have few distinct values per group, so a group's are ranked together; others are dealt by range."""
    if isinstance(counted.schema[value].dataType, T.IntegralType):
        group = Window.partitionBy(*keys)
        return counted.withColumn("_pos", F.sum("_w").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.sum("_w").over(group))
    return position_within(counted, keys, [F.col(value).asc()], out="_pos", with_group_size="_n", weight="_w")


def _picks(value: str, quantiles: dict[str, float]) -> list[Column]:
    """Nearest-rank values over ``_ranked`` rows: the value whose rows reach the rank."""
    out = []
    for name, p in quantiles.items():
        rank = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p)).cast("long")) + 1
        out.append(F.max(F.when((F.col("_pos") >= rank) & (F.col("_pos") - F.col("_w") < rank), F.col(value))).alias(name))
    return out


def nearest_rank(log: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """L4: per group, q = sorted[min(n − 1, floor(n·p))] for each named p, over its non-null values.

    Rows are first counted by value (map-side combined), so a value that a
    third of all rows have is one row with a weight, and only distinct values
    are ranked."""
    counted = log.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    return _ranked(counted, keys, value).groupBy(*keys).agg(*_picks(value, quantiles))


def step_digest(log: DataFrame) -> DataFrame:
    """L1: per (scenario, clients): rps, p50 / p97.5 / p99 / max latency and
    status-class counts. Duration is the step's time span (at least 1 s).

    Whole-number latencies are counted first, so that the log is read once, for
    a table with a row per step and latency; others are ranked by themselves.
    Rows without a latency count in all but the quantiles."""
    keys = ["scenario", "clients"]
    s = F.col("status")
    sums = {"total": F.count(F.lit(1)), "ok": F.count_if((s >= 200) & (s < 300)), "s4xx": F.count_if((s >= 400) & (s < 500)), "s5xx": F.count_if(s >= 500)}
    ends = [F.min("started_at").alias("_from"), F.max("started_at").alias("_to")]
    if isinstance(log.schema["latency_ms"].dataType, T.IntegralType):
        counted = log.groupBy(*keys, "latency_ms").agg(F.count_if(F.col("latency_ms").isNotNull()).alias("_w"), *ends, *[c.alias(n) for n, c in sums.items()])
        steps = _ranked(counted, keys, "latency_ms").groupBy(*keys).agg(
            F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("latency_ms").alias("max"), *[F.sum(n).alias(n) for n in sums], *_picks("latency_ms", QUANTILES))
    else:
        steps = log.groupBy(*keys).agg(*ends, F.max("latency_ms").alias("max"), *[c.alias(n) for n, c in sums.items()])
        steps = steps.join(nearest_rank(log, keys, "latency_ms", QUANTILES), keys, "left")
    span_s = F.greatest((F.unix_micros(F.col("_to").cast("timestamp")) - F.unix_micros(F.col("_from").cast("timestamp"))) / 1e6, F.lit(1.0))
    return steps.select(
        *keys, js_round(F.col("total") / span_s).alias("rps"), "p50", "p97_5", "p99", "max", "total", "ok", "s4xx", "s5xx"
    )


def unexpected_4xx(log: DataFrame, expected: dict[str, list[int]]) -> DataFrame:
    """4xx responses that the scenario does not expect, per step."""
    exp = F.lit(False)
    for scen, codes in expected.items():
        exp = exp | ((F.col("scenario") == scen) & F.col("status").isin(codes))
    s = F.col("status")
    return log.groupBy("scenario", "clients").agg(F.count_if((s >= 400) & (s < 500) & ~exp).alias("unexpected_4xx"))


def step_verdict(digest: DataFrame, log: DataFrame, expected: dict[str, list[int]]) -> DataFrame:
    """L2: a step breaks when more than 0.5 % of requests fail (5xx and
    unexpected 4xx) or p99 exceeds 2,000 ms; ``break`` holds the reason."""
    d = digest.join(unexpected_4xx(log, expected), ["scenario", "clients"], "left")
    u = F.coalesce(F.col("unexpected_4xx"), F.lit(0))
    failures = F.col("s5xx") + u
    rate = failures / F.greatest(F.col("total"), F.lit(1))
    pct_text = (F.floor(rate * 1000 + 0.5) / 10).cast("string")
    reason = (
        F.when(rate > FAIL_LIMIT, F.concat(pct_text, F.lit("% of requests failed ("), F.col("s5xx").cast("string"),
                                           F.lit(" server errors, 0 timeouts or connection errors, "), u.cast("string"),
                                           F.lit(" unexpected 4xx)")))
        .when(F.col("p99") > P99_LIMIT_MS, F.concat(F.lit("p99 latency "), F.col("p99").cast("string"),
                                                     F.lit(f" ms exceeds {P99_LIMIT_MS} ms")))
    )
    return d.select(*digest.columns, reason.alias("break"))


def ramp_summary(verdicts: DataFrame) -> DataFrame:
    """L3: steps run in client order until the first break; max rps; knee =
    first level reaching 95 % of max; comfortable = last level with no break
    and p99 ≤ 500 ms."""
    w = Window.partitionBy("scenario")
    first_break = F.min(F.when(F.col("break").isNotNull(), F.col("clients"))).over(w)
    ran = verdicts.withColumn("_fb", first_break).filter(F.col("_fb").isNull() | (F.col("clients") <= F.col("_fb")))
    ran = ran.withColumn("max_rps", F.max("rps").over(w))
    comfy = F.col("break").isNull() & (F.col("p99") <= COMFORT_P99_MS)
    return ran.groupBy("scenario").agg(
        F.first("max_rps").alias("max_rps"),
        F.min(F.when(F.col("rps") >= F.col("max_rps") * KNEE_SHARE, F.col("clients"))).alias("knee"),
        F.max(F.when(comfy, F.col("clients"))).alias("comfortable"),
        F.max_by(F.when(comfy, F.col("rps")), F.when(comfy, F.col("clients"))).alias("comfortable_rps"),
        F.min("_fb").alias("break_at"),
    )


def tenant_isolation_audit(contacts: DataFrame, tags: DataFrame, contact_tags: DataFrame, activity: DataFrame) -> DataFrame:
    """Rows that reach across accounts (expected 0) and e-mails used in
    more than one account (allowed)."""
    c = contacts.select(F.col("id").alias("contact_id"), F.col("account_id").alias("c_acc"))
    t = tags.select(F.col("id").alias("tag_id"), F.col("account_id").alias("t_acc"))
    links = contact_tags.join(c, "contact_id").join(t, "tag_id").agg(
        F.count_if(F.col("c_acc") != F.col("t_acc")).alias("violations")
    ).select(F.lit("link_crosses_accounts").alias("check"), "violations")
    acts = activity.select("contact_id", "account_id").join(c, "contact_id").agg(
        F.count_if(F.col("account_id") != F.col("c_acc")).alias("violations")
    ).select(F.lit("activity_crosses_accounts").alias("check"), "violations")
    shared = (
        contacts.filter(F.col("email").isNotNull())
        .groupBy("email")
        .agg(F.count_distinct("account_id").alias("_a"))
        .agg(F.count_if(F.col("_a") > 1).alias("violations"))
        .select(F.lit("email_in_several_accounts").alias("check"), "violations")
    )
    return links.unionByName(acts).unionByName(shared)


def import_throughput(jobs: DataFrame) -> DataFrame:
    """Rows per second for validation and import, per mode (completed jobs)."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    done = jobs.filter(F.col("status") == "completed")
    agg = done.groupBy("mode").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.sum("total_rows").cast("long").alias("rows"),
        (F.sum(us("validated_at") - us("created_at")) / 1e6).alias("_v"),
        (F.sum(us("finished_at") - us("validated_at")) / 1e6).alias("_i"),
    )
    return agg.select("mode", "jobs", "rows", js_round(F.col("rows") / F.col("_v")).alias("validate_rps"),
                      js_round(F.col("rows") / F.col("_i")).alias("import_rps"))

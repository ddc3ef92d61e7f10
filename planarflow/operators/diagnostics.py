"""Questions about a run's events and tables, as DataFrame aggregates.

Each takes DataFrames and column names, so the same operator serves a run's own tables and any others. Rates whose
denominator is zero are null; JSON that does not parse is skipped; sums of nothing are zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition."""
    return df.agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))


def multi_aggregate(df: DataFrame, key: str, value: str, distinct: str) -> DataFrame:
    """count, sum, min, max, mean of value, and distinct values of another column, by key."""
    v = F.col(value)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.coalesce(F.sum(v), F.lit(0)).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.countDistinct(distinct).alias("n_distinct"))


def sums_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def top(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *ties).limit(k)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def latest(df: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(order, *ties)).alias("_row")).select("_row.*")


def first_wins(df: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """The first row of each key: what inserting without replacing leaves."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(order, *ties)).alias("_row")).select("_row.*")


def least_payload(df: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """The least payload of each key."""
    return df.groupBy(*keys).agg(F.min(payload).alias(payload))


def with_counts(owners: DataFrame, key: str, items: DataFrame, item_key: str, **conditions: Column) -> DataFrame:
    """owners with the number of their items that meet each condition, 0 where there are none."""
    held = items.groupBy(F.col(item_key).alias(key)).agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))
    return owners.join(held, key, "left").fillna(0, list(conditions))


def without(df: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows of df whose key others lack."""
    return df.join(others.select(F.col(other_key).alias(key)), key, "left_anti")


def having(df: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    return df.join(others.select(F.col(other_key).alias(key)), key, "left_semi")


def payload_sums(events: DataFrame, payload: str, fields: Sequence[str], *keys: str) -> DataFrame:
    """Events and sums of JSON fields by key; what does not parse counts as nothing."""
    parsed = F.from_json(payload, ", ".join(f"{f} double" for f in fields), {"mode": "PERMISSIVE"})
    return events.withColumn("_p", parsed).groupBy(*keys).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"_p.{f}"), F.lit(0.0)).alias(f) for f in fields))


EVENT = "timestamp double, event_type string, payload_json string"
_STEP = "struct<edge:array<int>, seconds:double, routes:bigint, drawings:bigint, infeasible:bigint>"
PAYLOAD = f"stage_index int, candidates_seen bigint, candidates_submitted bigint, elapsed_seconds double, profile struct<worker_cpu_seconds:double, worker_max_rss_kib:bigint, block:struct<kind:string, vertex:int, total_seconds:double, steps:array<{_STEP}>>>"


def stage_summary(events: DataFrame) -> DataFrame:
    """By event type and stage: tasks, candidates, CPU seconds, peak memory, and the span from the first start to the last end."""
    x = events.withColumn("p", F.from_json("payload_json", PAYLOAD)).where("p.stage_index IS NOT NULL")
    zero = F.lit(0)
    return x.groupBy("event_type", F.col("p.stage_index").alias("stage_index")).agg(
        F.count("*").alias("tasks"),
        F.coalesce(F.sum("p.candidates_seen"), zero).alias("seen"),
        F.coalesce(F.sum("p.candidates_submitted"), zero).alias("submitted"),
        F.coalesce(F.sum("p.profile.worker_cpu_seconds"), F.lit(0.0)).alias("cpu_seconds"),
        F.max("p.profile.worker_max_rss_kib").alias("max_rss_kib"),
        (F.max("timestamp") - F.min(F.col("timestamp") - F.col("p.elapsed_seconds"))).alias("span_seconds"),
        F.coalesce(F.sum("p.profile.block.total_seconds"), F.lit(0.0)).alias("block_seconds"),
    )


def step_summary(events: DataFrame) -> DataFrame:
    """By stage and step: sums over tasks."""
    x = events.withColumn("p", F.from_json("payload_json", PAYLOAD)).select("p.stage_index", F.posexplode("p.profile.block.steps").alias("step", "s"))
    return x.groupBy("stage_index", "step").agg(*(F.coalesce(F.sum(f"s.{c}"), F.lit(0)).alias(c) for c in ("seconds", "routes", "drawings", "infeasible")))


def operation_timings(timings: DataFrame, k: int | None = None) -> DataFrame:
    """Count, total and longest time of each operation, the costliest first."""
    x = timings.groupBy("operation").agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.max("seconds").alias("longest")).orderBy(F.desc("total"), "operation")
    return x if k is None else x.limit(k)


def stage_rates(events: DataFrame) -> DataFrame:
    """stage_summary with candidates a second and the share that was submitted; null where nothing was seen or no time passed."""
    x = stage_summary(events)
    return x.withColumn("seen_per_second", ratio(F.col("seen"), F.col("span_seconds"))).withColumn("submitted_share", ratio(F.col("submitted"), F.col("seen")))


def active_workers(events: DataFrame, worker: Column, now: DataFrame, within: float = 120.0) -> DataFrame:
    """Workers with a sign of life within so many seconds of now, one row with that column, and their last one."""
    x = events.withColumn("worker", worker).where(F.col("worker").isNotNull()).groupBy("worker").agg(F.max("timestamp").alias("last_seen"))
    return x.join(F.broadcast(now), F.col("last_seen") >= F.col("now") - within).select("worker", "last_seen")


def requeued(leases: DataFrame, now: float) -> DataFrame:
    """The work table after leases that have passed are given back: their status is pending, their owner and time null."""
    gone = (F.col("status") == "leased") & (F.col("lease_until") < F.lit(now))
    return leases.withColumns({"status": F.when(gone, F.lit("pending")).otherwise(F.col("status")), "owner": F.when(~F.coalesce(gone, F.lit(False)), F.col("owner")), "lease_until": F.when(~F.coalesce(gone, F.lit(False)), F.col("lease_until"))})


def throughput_mb(spans: DataFrame, size: str, begin: str, end: str, *keys: str) -> DataFrame:
    """MB, seconds from the first begin to the last end, and MB a second, by key."""
    x = spans.groupBy(*keys).agg((F.sum(size) / 1e6).alias("mb"), (F.max(end) - F.min(begin)).alias("seconds"))
    return x.withColumn("mb_per_second", ratio(F.col("mb"), F.col("seconds")))


def expired(leases: DataFrame, now: float) -> DataFrame:
    """Leased work whose time has passed."""
    return leases.where((F.col("status") == "leased") & (F.col("lease_until") < F.lit(now)))


def silences(events: DataFrame, keys: Sequence[str], at: str, lease: float) -> DataFrame:
    """Per keys: how often more than lease seconds lie between two events that follow each other.

    Gaps are counted within hours, and between hours from each one's first and last event, so that a key of very many events is
    sorted in parts; a key has at most one row per hour in the second step."""
    x = events.select(*keys, F.date_trunc("hour", at).alias("_hour"), F.col(at).alias("_at"))
    late = lambda a, b: ((F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) > F.lit(int(lease * 1e6)))
    inside = Window.partitionBy(*keys, "_hour").orderBy("_at")
    hours = x.withColumn("_before", F.lag("_at").over(inside)).groupBy(*keys, "_hour").agg(F.count_if(late("_before", "_at")).alias("_n"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_hour")
    return hours.withColumn("_before", F.lag("_last").over(across)).groupBy(*keys).agg((F.sum("_n") + F.count_if(late("_before", "_first"))).alias("silences"))

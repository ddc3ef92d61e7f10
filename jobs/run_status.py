"""Status of a long run from its event log, by day: taken in as a stream, only what is new.

    python -m jobs.run_status --source LOG --output OUT --checkpoint MARKS [--config FILE]

LOG is a folder of Parquet event files that grows, or a pattern of such files. The stream's checkpoint knows which files were read. Each batch is
added to OUT/events by day and batch; then the status of the days that it touches is made anew from all their events and replaces
these days in OUT/status, so late events, events that are delivered again and batches that are run again after a failure all give
the same status. Events without a time go to OUT/rejected. A run without new files writes nothing.

OUT/status has, per day and event type, and per day with a null type for all of them: events, users, total and largest value,
sum of the payload's counter, payloads without one, first and last second of the day, and for the whole day the silences: how
often a user was silent for longer than a lease between two events of that day.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, settings
from planarflow.operators.diagnostics import silences

log = logging.getLogger("jobs.run_status")
STATUS = "event_type string, events long, users long, total double, highest double, counter long, bare long, first_second int, last_second int, silences long, day date"


def take_in(batch: DataFrame, number: int, output: str, config: dict) -> list:
    """Add a batch's events to OUT/events; returns the days that it touches."""
    rows = batch.withColumn("day", F.to_date("ts")).withColumn("event_type", F.coalesce("event_type", F.lit("unknown"))).withColumn("batch", F.lit(number))
    add = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{output}/{name}")
    add(rows.where("day IS NOT NULL").hint("rebalance", "day"), "events", "day", "batch")
    add(rows.where("day IS NULL").drop("day"), "rejected", "batch")
    mine = F.col("batch") == number
    kept = batch.sparkSession.read.schema(f"{config['schema']}, day date, batch int").parquet(f"{output}/events").where(mine).groupBy("day").count().collect()  # days, not events
    rejected = batch.sparkSession.read.schema(f"{config['schema']}, batch int").parquet(f"{output}/rejected").where(mine).count()
    log.info("batch %s: read %s events of %s days and %s without a time", number, sum(r["count"] for r in kept), len(kept), rejected)
    return [r["day"] for r in kept]


def status(events: DataFrame, config: dict) -> DataFrame:
    """The status of all days of events; equal rows are one event delivered more than once."""
    once = events.distinct()
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    count = F.get_json_object("props", config["counter"]).try_cast("long")
    sums = once.withColumn("second", second).withColumn("count", count).groupingSets([["day", "event_type"], ["day"]], "day", "event_type").agg(
        F.count("*").alias("events"),
        F.countDistinct("user_id").alias("users"),
        F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"),
        F.max("value").alias("highest"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("counter"),
        F.count_if(F.col("count").isNull()).alias("bare"),
        F.min("second").alias("first_second"),
        F.max("second").alias("last_second"),
    )
    gaps = silences(once, ["day", "user_id"], "ts", config["lease_seconds"]).groupBy("day").agg(F.sum("silences").alias("silences"))
    whole = F.col("event_type").isNull()
    return sums.join(gaps, "day").withColumn("silences", F.when(whole, F.col("silences"))).select("event_type", "events", "users", "total", "highest", "counter", "bare", "first_second", "last_second", "silences", "day")


def make_status(spark: SparkSession, output: str, days: list, config: dict) -> None:
    """Put the status of these days in place of what OUT/status has of them."""
    schema = f"{config['schema']}, day date, batch int"
    events = spark.read.schema(schema).parquet(f"{output}/events").where(F.col("day").isin(days)).drop("batch")
    status(events, config).hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{output}/status")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Take in the event files that are new in SOURCE and bring OUTPUT/status up to date."""
    config = config or settings(None, "run_status.json")
    did = {"batches": 0, "days": 0}

    def batch(rows: DataFrame, number: int) -> None:
        days = take_in(rows, number, output, config)
        if days:
            make_status(rows.sparkSession, output, days, config)
        did["batches"] += 1
        did["days"] += len(days)

    events = spark.readStream.schema(config["schema"]).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    stream = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("read %s: %s batches; wrote %s: the status of %s days", source, did["batches"], output, did["days"])
    return did


def result(spark: SparkSession, output: str) -> DataFrame:
    """OUTPUT/status as it stands."""
    return spark.read.schema(STATUS).parquet(f"{output}/status")


if __name__ == "__main__":
    main("run_status", {"source": "folder or pattern of event files", "output": "folder to write to", "checkpoint": "folder of the stream's marks"}, run)

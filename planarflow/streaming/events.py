"""A run's event log as a stream: stage progress, live workers, and flags without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from planarflow.operators.diagnostics import EVENT, PAYLOAD
from planarflow.sources.folders import exists, new_folder

#: Seconds after which work that shows no sign of life is given to others; longest delay of an event.
LEASE, LATE = 300, "10 minutes"


def read_events(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """JSON lines of events, with their time as ts."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).json(path)
    return raw.withColumn("ts", F.timestamp_seconds("timestamp"))


def stage_progress(events: DataFrame) -> DataFrame:
    """Running sums by event type and stage."""
    x = events.withColumn("p", F.from_json("payload_json", PAYLOAD)).where("p.stage_index IS NOT NULL")
    return x.groupBy("event_type", F.col("p.stage_index").alias("stage_index")).agg(F.count("*").alias("tasks"), F.sum("p.candidates_seen").alias("seen"), F.sum("p.candidates_submitted").alias("submitted"))


def throughput(events: DataFrame, window: str = "1 minute") -> DataFrame:
    """Events and candidates in windows of event time; windows close when the watermark passes them."""
    x = events.withWatermark("ts", LATE).withColumn("p", F.from_json("payload_json", PAYLOAD))
    return x.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("p.candidates_seen"), F.lit(0)).alias("seen"))


def sessions(events: DataFrame, lease: int = LEASE) -> DataFrame:
    """Stretches in which a worker (payload field worker_id) was alive: gaps longer than the lease end one."""
    x = events.withWatermark("ts", LATE).withColumn("worker_id", F.get_json_object("payload_json", "$.worker_id"))
    return x.groupBy(F.session_window("ts", f"{lease} seconds"), "worker_id").agg(F.count("*").alias("beats"))


def distinct_flags(rows: DataFrame) -> DataFrame:
    """The first of each flag; rows have flag and ts, repeats that come later than the watermark are not remembered."""
    return rows.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["flag"])


def drain(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its result, a table in the shared folder.

    In the mode append the rows are written as they come; in complete each batch's result replaces the one before."""
    spark, home = df.sparkSession, new_folder(df.sparkSession, "stream")
    out = df.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/marks").trigger(availableNow=True)
    if mode == "append":
        query: StreamingQuery = out.format("parquet").start(f"{home}/out")
    else:
        query = out.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{home}/out")).start()
    query.awaitTermination()
    if not exists(spark, f"{home}/out"):  # a stream without batches
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{home}/out")

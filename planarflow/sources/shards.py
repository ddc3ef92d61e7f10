"""Shards of each kind of record, written and scanned as tables: candidates, classes and flags in record files by bucket.

A shard's folder names the first hex digits of its records' hash, so that the scan of a bucket opens the files of that bucket only.
Rows with a null in a field that their record holds give no record, as they are none.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planarflow.functions import formats
from planarflow.sources.record_source import RecordSource

#: Kind of record: its columns, of which the first hash says the bucket, and how they become a record and come from it.
KINDS = {
    "raw": (("bucket_hash", "payload"), formats.raw, lambda r, fallback: formats.raw_parts(r, fallback)),
    "reduced": (("report_hash", "work_hash", "payload"), formats.reduced, lambda r, fallback: formats.reduced_parts(r)),
    "flag": (("flag_hash", "invariant", "flag"), formats.flagged, lambda r, fallback: formats.flagged_parts(r)),
}
PREFIX = "prefix"


def bucket_prefix(hash_: Column | str, digits: int = 2) -> Column:
    return F.substring(hash_, 1, digits)


def write_shards(rows: DataFrame, path: str, kind: str, digits: int = 2) -> None:
    """Add rows, with the columns of their kind, to the shards under path."""
    rows.sparkSession.dataSource.register(RecordSource)
    columns, encode, _ = KINDS[kind]
    out = rows.select(encode(*(F.col(c) for c in columns)).alias("record"), bucket_prefix(columns[0], digits).alias(PREFIX)).where("record IS NOT NULL")
    out.hint("rebalance", PREFIX).sortWithinPartitions(PREFIX).write.format("records").option("key", PREFIX).mode("append").save(path)


def scan_shards(spark: SparkSession, path: str, kind: str, prefixes: Sequence[str] | None = None, fallback: str | None = None) -> DataFrame:
    """prefix, file and the columns of the kind, of all buckets or some; raw records without a header get the fallback's bucket."""
    spark.dataSource.register(RecordSource)
    options = {"key": PREFIX} | ({} if prefixes is None else {"keys": json.dumps(list(prefixes))})
    read = spark.read.format("records").options(**options).load(path)
    parts = KINDS[kind][2](F.col("record"), F.lit(fallback).cast("string"))
    return read.select(PREFIX, "file", parts.alias("p")).select(PREFIX, "file", "p.*")


def shard_sizes(shards: DataFrame) -> DataFrame:
    """Records of each file of a scan."""
    return shards.groupBy(PREFIX, "file").agg(F.count("*").alias("records"))


def write_lines(lines: DataFrame, path: str, columns: Sequence[str], tasks: int | None = None) -> None:
    """Lines of tab-separated columns as gzip text files in the order of the columns: read one after another by name, they are sorted."""
    tasks = tasks or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(tasks, *columns).sortWithinPartitions(*columns)
    ranged.select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)

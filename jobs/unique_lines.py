"""Distinct lines of a text table in sorted bucket files, with a manifest: export, sort, remove repeats, split into buckets.

    python -m jobs.unique_lines --source DOCUMENTS --output OUT [--config FILE]

DOCUMENTS is a Parquet table with doc_id and text. A line's bucket is the beginning of its SHA-256 in hex, as in an export of flags.
OUT/records has one folder per bucket; in it the bucket's distinct lines in the order of their bytes, each with the number of its
occurrences and the least doc_id that has it. OUT/manifest is one CSV of the buckets: records, bytes (with a line end each), first
row and a checksum that does not depend on order. Empty lines and null texts are left out; a carriage return before a line's end is
not part of it. Every run writes everything anew and gives the same rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, settings
from planarflow.operators import ordered

log = logging.getLogger("jobs.unique_lines")
RECORDS = "line string, n long, first_doc long, _at long, bucket string"
MANIFEST = "bucket string, records long, bytes long, first_row long, checksum long"
#: Hex digits of a line's digest that its checksum takes, and the modulus of their sum.
DIGITS, MODULUS = 12, 1 << 48


def lines(docs: DataFrame, digits: int) -> DataFrame:
    """bucket, line and doc_id of every line that is not empty."""
    parts = docs.select("doc_id", F.explode(F.split("text", "\r?\n")).alias("line")).where("line <> ''")
    return parts.withColumn("bucket", F.substring(F.sha2("line", 256), 1, digits))


def checksum(line) -> F.Column:
    number = F.conv(F.substring(F.sha2(line, 256), 1, DIGITS), 16, 10).cast("decimal(38,0)")
    return F.pmod(F.sum(number), F.lit(MODULUS)).cast("long")


def run(spark: SparkSession, source: str, output: str, config: dict | None = None) -> dict:
    """Write the distinct lines of SOURCE to OUTPUT/records and their manifest."""
    config = config or settings(None, "unique_lines.json")
    rows = lines(spark.read.parquet(source).select("doc_id", "text"), config["bucket_digits"])
    ordered.sort_unique(rows, ["bucket", "line"], f"{output}/records", "bucket", {"first_doc": F.min("doc_id")}, config["tasks"])
    kept = ordered.numbered(spark.read.schema(RECORDS).parquet(f"{output}/records"))
    size = F.octet_length("line") + 1
    read = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
    own = ordered.manifest(kept, "bucket", size).join(kept.groupBy("bucket").agg(checksum("line").alias("checksum")), "bucket")
    # One row per bucket: 16 to the power of the digits.
    own.coalesce(1).sortWithinPartitions("bucket").write.mode("overwrite").option("header", True).csv(f"{output}/manifest")
    total = manifest(spark, output).agg(F.count("*").alias("buckets"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first()
    did = read.first().asDict() | total.asDict()
    log.info("read %s: %s lines; wrote %s: %s records of %s bytes in %s buckets", source, did["lines"], output, did["records"], did["bytes"], did["buckets"])
    return did


def manifest(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", True).csv(f"{output}/manifest")


def result(spark: SparkSession, output: str) -> DataFrame:
    """OUTPUT as it stands: every record with its row number, its place in its bucket, and its bucket's manifest."""
    held = manifest(spark, output)
    rows = ordered.in_key(ordered.numbered(spark.read.schema(RECORDS).parquet(f"{output}/records")), held, "bucket")
    return rows.join(held.select("bucket", "records", "bytes", "checksum"), "bucket").select("bucket", "row", "place", "line", "n", "first_doc", "records", "bytes", "checksum")


if __name__ == "__main__":
    main("unique_lines", {"source": "table of documents", "output": "folder to write to"}, run)

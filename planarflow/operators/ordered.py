"""Sorted, numbered and size-bounded files: what an external sort, a split at key changes and a shard writer give.

Rows are reduced to distinct ones first, with repeats counted before the shuffle, so that no value is frequent when the rest is
dealt out by ranges of all sort columns; ranges are then as even as Spark's sample of them. Each range is sorted and written by one
task, split into folders by the key if one is given, in one pass: rows lie in the files in order, and files in the order of their
ranges. Row numbers without gaps take no sort and no single task: each row keeps its range and its place in it, and what lies before
a range is a sum over ranges. Nulls sort first. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planarflow.sources.folders import written

AT = "_at"
#: monotonically_increasing_id has the task in its upper bits and the row within it in these.
ROW_BITS = 33


def sort_unique(df: DataFrame, columns: Sequence[str], path: str, key: str | None = None, more: dict[str, Column] | None = None, tasks: int | None = None) -> None:
    """Write the distinct values of columns in their order, with n, how often each occurred, and further aggregates.

    With a key, which must be the first column, files lie in a folder of each of its values."""
    if key and key != columns[0]:
        raise ValueError("the key must be the first column")
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.groupBy(*columns).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in (more or {}).items()))
    out = held.repartitionByRange(tasks, *columns).sortWithinPartitions(*columns).withColumn(AT, F.monotonically_increasing_id())
    writer = out.write.mode("overwrite")
    (writer.partitionBy(key) if key else writer).parquet(path)


def _range() -> Column:
    return F.shiftrightunsigned(AT, ROW_BITS)


def _within() -> Column:
    return F.col(AT).bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of a table that sort_unique wrote, with row, their number from 0 in the whole order."""
    # One row per range: bounded by the number of tasks that wrote them.
    sizes = rows.groupBy(_range().alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    out = rows.withColumn("_range", _range()).join(F.broadcast(starts), "_range")
    return out.withColumn("row", F.col("_before") + _within()).drop("_range", "_before")


def manifest(rows: DataFrame, key: str, size: Column) -> DataFrame:
    """Per key: number of records, bytes, and the least row number; rows come from numbered()."""
    return rows.groupBy(key).agg(F.count("*").alias("records"), F.sum(size).alias("bytes"), F.min("row").alias("first_row"))


def in_key(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Numbered rows with place, their number from 0 among those of their key; keys comes from manifest()."""
    return rows.join(keys.select(key, "first_row"), rows[key].eqNullSafe(keys[key]), "left").drop(keys[key]).withColumn("place", F.col("row") - F.col("first_row")).drop("first_row")


def placed(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table that sort_unique wrote by key, with row, place and records, as numbered(), in_key() and manifest() give.

    The files of many keys are small and cost their opening, so they are read twice only: for what each key has in each range, and for the rows."""
    parts = written(rows.groupBy(key, _range().alias("_range")).agg(F.count("*").alias("_n"), F.min(_within()).alias("_first")), "parts")
    sizes = parts.groupBy("_range").agg(F.sum("_n").alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    keys = parts.join(F.broadcast(starts), "_range").groupBy(F.col(key).alias("_key")).agg(F.min(F.col("_before") + F.col("_first")).alias("_first_row"), F.sum("_n").alias("records"))
    out = rows.withColumn("_range", _range()).join(F.broadcast(starts), "_range").withColumn("row", F.col("_before") + _within())
    out = out.join(keys, F.col(key).eqNullSafe(F.col("_key")))
    return out.withColumn("place", F.col("row") - F.col("_first_row")).drop("_range", "_before", "_key", "_first_row")


# --- files of bounded size --------------------------------------------------------------------------


def deal_by_bytes(rows: DataFrame, size: Column, limit: int) -> DataFrame:
    """Rows (from numbered() or with an AT column of their own) with shard and offset: consecutive rows share a shard of at most limit bytes.

    Bytes before a row are summed within its range and over ranges. A shard begins at every full (limit - longest row) bytes, so no
    row has to be placed by one that was dealt before it. Rows longer than half the limit have shards of their own, from -1 down."""
    sized = rows.withColumn("_size", size.cast("long")).withColumn("_range", _range())
    whole = F.col("_size") * 2 > limit
    sized = sized.withColumn("_small", F.when(whole, F.lit(0)).otherwise(F.col("_size"))).withColumn("_big", whole.cast("long"))
    totals = sized.groupBy("_range").agg(F.sum("_small").alias("_s"), F.sum("_big").alias("_b"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}0") for c in ("_s", "_b")))
    inside = Window.partitionBy("_range").orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c, start: F.col(start) + F.coalesce(F.sum(c).over(inside), F.lit(0))
    step = limit - limit // 2
    out = sized.join(F.broadcast(starts), "_range").withColumn("_before", run("_small", "_s0")).withColumn("_bigs", run("_big", "_b0"))
    shard = F.when(F.col("_big") == 1, -1 - F.col("_bigs")).otherwise(F.floor(F.col("_before") / step))
    # The first row of a shard begins at the least place of it; its other rows' offsets count from there.
    out = out.withColumn("shard", shard)
    firsts = out.where("_big = 0").groupBy("shard").agg(F.min("_before").alias("_first"))
    out = out.join(firsts, "shard", "left").withColumn("offset", F.when(F.col("_big") == 1, F.lit(0)).otherwise(F.col("_before") - F.col("_first")))
    return out.drop("_range", "_size", "_small", "_big", "_s0", "_b0", "_before", "_bigs", "_first")

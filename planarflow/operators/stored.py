"""Changes merged batch after batch into a stored table: insert or ignore, replace, update on conflict, update, delete.

The table is Parquet, partitioned by a value that its keys determine: an own column of the keys, or a number that their hash gives.
A merge reads only the partitions that the batch's keys can lie in, joins them with the batch once, and rewrites by dynamic
partition overwrite only those in which a row did change; the files of all others stay as they are.

Each row carries the number of the last batch that changed it. A batch that is run again, whole or after it stopped half-way, skips
the rows that it has changed already, so sums are not taken twice and a stream's foreachBatch can call a merge with its batch number.
Batches come in ascending order. What a merge is about to write is first written beside the table; a merge that was stopped while
partitions were replaced is finished from there by the next one.

Null keys are values like any other and equal to each other. Deleted rows stay as marks, which later batches may fill again, until
compact() drops them. Within a batch, rows of a key count in the given order, then by all their columns, so that a result does not
depend on how rows are dealt. A batch without rows changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planarflow.sources.folders import delete as remove
from planarflow.sources.folders import exists, finished

BATCH, GONE, PART = "_batch", "_gone", "_part"
#: Partitions of a table whose keys hold no column to partition by.
PARTS = 16
#: What a rule makes of a stored value and of a batch's values, which are given in order.
RULES: dict[str, tuple[Callable[[str, Column], Column], Callable[[Column, Column], Column]]] = {
    "first": (lambda c, order: F.min_by(c, order), lambda old, new: old),
    "last": (lambda c, order: F.max_by(c, order), lambda old, new: new),
    "sum": (lambda c, order: F.sum(c), lambda old, new: F.when(old.isNull(), new).otherwise(old + F.coalesce(new, F.lit(0)))),
    "min": (lambda c, order: F.min(c), lambda old, new: F.least(old, new)),
    "max": (lambda c, order: F.max(c), lambda old, new: F.greatest(old, new)),
}


def part_of(keys: Sequence[str], partition: str | None, parts: int) -> Column:
    """The partition of a row, as text."""
    return (F.col(partition) if partition else F.pmod(F.xxhash64(*keys), F.lit(parts))).cast("string")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "false").parquet(path).withColumn(PART, F.col(PART).cast("string"))


def _inside(parts: list[str | None]) -> Column:
    """The partitions named, in a form that prunes folders."""
    known = [p for p in parts if p is not None]
    return F.col(PART).isin(known) | F.col(PART).isNull() if None in parts else F.col(PART).isin(known)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows."""
    return _stored(spark, path).where(f"NOT {GONE}").drop(BATCH, GONE, PART)


def changed_by(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The rows that a batch changed last."""
    return _stored(spark, path).where((F.col(BATCH) == batch) & ~F.col(GONE)).drop(BATCH, GONE, PART)


def _staged(path: str) -> str:
    return f"{path.rstrip('/')}_staged"


def _replace(spark: SparkSession, path: str) -> list[str | None]:
    """Put the partitions that were written beside the table in place; returns them."""
    beside = _staged(path)
    if not finished(spark, beside):
        return []
    rows = spark.read.parquet(beside)
    touched = [r[0] for r in rows.where("_changed").select(PART).distinct().collect()]  # partitions of the table, not keys
    if touched:
        # Rows of a partition go to as many tasks as their bytes need.
        out = rows.where(_inside(touched)).drop("_changed").hint("rebalance", PART)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    remove(spark, beside)
    return touched


def _put(path: str, rows: DataFrame) -> list[str | None]:
    rows.write.mode("overwrite").parquet(_staged(path))
    return _replace(rows.sparkSession, path)


def _merge(changes: DataFrame, path: str, keys: Sequence[str], rules: dict[str, str], batch: int, order: Sequence[str], partition: str | None, parts: int) -> list[str | None]:
    spark, keys = changes.sparkSession, list(keys)
    _replace(spark, path)
    columns = [c for c in changes.columns if c not in keys]
    if unknown := set(rules) ^ set(columns):
        raise ValueError(f"rules and columns differ in {sorted(unknown)}")
    place = F.struct(*order, *(c for c in changes.columns if c not in order))
    new = changes.groupBy(*keys).agg(*(RULES[rules[c]][0](F.col(c), place).alias(f"new_{c}") for c in columns), F.lit(True).alias("_new")).withColumn(PART, part_of(keys, partition, parts))
    if not exists(spark, path):
        fresh = new.select(*keys, *(F.col(f"new_{c}").alias(c) for c in columns), F.lit(batch).cast("long").alias(BATCH), F.lit(False).alias(GONE), PART, F.lit(True).alias("_changed"))
        return _put(path, fresh)
    touched = [r[0] for r in changes.select(part_of(keys, partition, parts).alias(PART)).distinct().collect()]
    if not touched:
        return []
    old = _stored(spark, path).where(_inside(touched)).withColumn("_old", F.lit(True)).alias("o")
    both = old.join(new.alias("n"), reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in [*keys, PART])), "full")
    known, fills = F.col("_old").isNotNull(), F.coalesce(F.col(f"o.{GONE}"), F.lit(True))
    ignored = known & ~fills & F.lit(all(r == "first" for r in rules.values()))
    applies = F.col("_new").isNotNull() & (~known | (F.col(f"o.{BATCH}") < batch)) & ~ignored
    value = lambda c: F.when(~applies, F.col(f"o.{c}")).when(fills, F.col(f"new_{c}")).otherwise(RULES[rules[c]][1](F.col(f"o.{c}"), F.col(f"new_{c}")))
    out = both.select(
        *(F.when(known, F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in keys),
        *(value(c).alias(c) for c in columns),
        F.when(applies, F.lit(batch).cast("long")).otherwise(F.col(f"o.{BATCH}")).alias(BATCH),
        (~applies & fills).alias(GONE),
        F.when(known, F.col(f"o.{PART}")).otherwise(F.col(f"n.{PART}")).alias(PART),
        applies.alias("_changed"),
    )
    return _put(path, out)


def insert_new(changes: DataFrame, path: str, keys: Sequence[str], batch: int, order: Sequence[str] = (), partition: str | None = None, parts: int = PARTS) -> list[str | None]:
    """Insert or ignore: a key's first row stays. Returns the partitions that were rewritten, as all of these do."""
    return _merge(changes, path, keys, {c: "first" for c in changes.columns if c not in keys}, batch, order, partition, parts)


def replace(changes: DataFrame, path: str, keys: Sequence[str], batch: int, order: Sequence[str] = (), partition: str | None = None, parts: int = PARTS) -> list[str | None]:
    """Insert or replace: a key's last row stays."""
    return _merge(changes, path, keys, {c: "last" for c in changes.columns if c not in keys}, batch, order, partition, parts)


def combine(changes: DataFrame, path: str, keys: Sequence[str], rules: dict[str, str], batch: int, order: Sequence[str] = (), partition: str | None = None, parts: int = PARTS) -> list[str | None]:
    """Insert, or on conflict update: each column by its rule (first, last, sum, min, max) over stored and new values."""
    return _merge(changes, path, keys, rules, batch, order, partition, parts)


def _rewrite(spark: SparkSession, path: str, hit: Column, values: dict[str, Column], batch: int) -> list[str | None]:
    _replace(spark, path)
    rows = _stored(spark, path)
    hit = F.coalesce(hit, F.lit(False)) & ~F.col(GONE) & (F.col(BATCH) < batch)
    touched = [r[0] for r in rows.where(hit).select(PART).distinct().collect()]
    if not touched:
        return []
    new = values | {BATCH: F.lit(batch).cast("long")}
    out = rows.where(_inside(touched)).withColumn("_changed", hit)
    return _put(path, out.select(*(F.when(F.col("_changed"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns), "_changed"))


def update(spark: SparkSession, path: str, where: Column, values: dict[str, Column], batch: int) -> list[str | None]:
    """Set columns of the rows that meet a condition; keys cannot be set."""
    return _rewrite(spark, path, where, values, batch)


def delete(spark: SparkSession, path: str, where: Column, batch: int) -> list[str | None]:
    """Delete the rows that meet a condition."""
    return _rewrite(spark, path, where, {GONE: F.lit(True)}, batch)


def compact(spark: SparkSession, path: str) -> list[str | None]:
    """Drop the marks of deleted rows from the partitions that keep others; the next merge sees their keys as new."""
    _replace(spark, path)
    rows = _stored(spark, path)
    live = [r[0] for r in rows.groupBy(PART).agg(F.count_if(GONE).alias("g"), F.count_if(~F.col(GONE)).alias("n")).where("g > 0 AND n > 0").select(PART).collect()]
    return _put(path, rows.where(_inside(live) & ~F.col(GONE)).withColumn("_changed", F.lit(True))) if live else []

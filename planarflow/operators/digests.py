"""Distinct payloads by short digests, with proof: payloads that only share a digest stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planarflow.sources.folders import written


def short_digest(payload: str, digits: int) -> Column:
    """The first hex digits of the payload's SHA-256."""
    return F.substring(F.sha2(payload, 256), 1, digits)


def distinct_by_digest(df: DataFrame, payload: str, digest: Column) -> DataFrame:
    """digest, payload, n (rows with this payload) and collided, whether another payload has its digest.

    Rows are grouped by the digest; a group whose least and greatest payload are the same bytes is one payload, which is the proof.
    Only rows of other groups are grouped by their payloads as well. Both steps combine before they shuffle, so neither a frequent
    payload nor a digest of few values, under which everything collides, moves a payload more than once per task. A null payload is
    one of its own, with a null digest."""
    rows = df.select(digest.alias("digest"), F.col(payload).alias("payload"))
    groups = written(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("payload").alias("payload"), F.max("payload").alias("_most")), "digests")
    proven = F.col("payload").eqNullSafe(F.col("_most"))
    alone = groups.where(proven).select("digest", "payload", "n", F.lit(False).alias("collided"))
    mixed = groups.where(~proven).select("digest")
    # Adaptive execution broadcasts the mixed digests where they are few.
    split = rows.join(mixed, "digest", "left_semi").groupBy("digest", "payload").agg(F.count("*").alias("n")).withColumn("collided", F.lit(True))
    return alone.unionByName(split)

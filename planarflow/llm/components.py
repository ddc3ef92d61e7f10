"""Connected components by alternating stars, with a written table after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component), component the smallest node that edges (u, v: long) reach; only nodes with an edge to another one.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest it knows; a hub's edges are never
    gathered in one task, since minima are pre-aggregated and the join back can be split."""
    own = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(own)
    while mark[0]:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").distinct(), "edges")
        release(own, large)
        own, (old, mark) = new, (mark, _mark(new))
        if old == mark:
            break
    return own.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

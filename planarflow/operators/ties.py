"""The best rows of each key with all ties, tier after tier."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_rows(df: DataFrame, keys: Sequence[str], tiers: Sequence[tuple[Column, str]]) -> DataFrame:
    """Rows of each key that are best (max or min) in the first tier, of these the best in the second one, and so on.

    A tier is computed only for rows that the tiers before left, which is what makes a costly one affordable; rows are told apart
    by nothing but their values, so all that tie stay. A tier is a maximum that combines before its shuffle and a join back, which
    can be split or broadcast: no key's rows are sorted or gathered. Null values lose against all others and tie with each other;
    null keys are a key."""
    out = df
    for i, (value, how) in enumerate(tiers):
        if how not in ("max", "min"):
            raise ValueError(f"a tier is max or min, not {how}")
        scored = out.withColumn("_tier", value)
        best = scored.groupBy(*keys).agg((F.max if how == "max" else F.min)("_tier").alias("_best"))
        names = [f"_k{i}_{j}" for j in range(len(keys))]
        best = best.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), "_best")
        same = reduce(lambda a, b: a & b, (scored[k].eqNullSafe(best[n]) for k, n in zip(keys, names)), scored["_tier"].eqNullSafe(best["_best"]))
        out = scored.join(best, same, "left_semi").drop("_tier")
    return out

"""Flags: text encodings of what crosses in a drawing, their buckets, and their classes under relabeling. Built-in functions only.

A flag is "<n> 0 <color ...> <count> <token ...>". A crossing token has the two edges' labels, each ascending, the smaller
edge first; a four-vertex token has the four labels ascending. Both lose the order of crossings along edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planarflow.plans.graph import Census, Points

KINDS = ("crossing", "four")


def checked_colors(colors: Sequence[int], m: int, n: int) -> tuple[int, ...]:
    """The colors of a graph's vertices if m of them are of one and n of the other color, in either order; others raise."""
    held = tuple(colors)
    sizes = sorted((held.count(c) for c in set(held)))
    if len(held) != m + n or sizes != sorted((m, n)) or set(held) != {1, 2}:
        raise ValueError(f"{held} colors no K({m},{n})")
    return held


def label(vertex: int, offset: int) -> int:
    if not 0 <= vertex + offset <= 9:
        raise ValueError(f"label {vertex + offset} is not one digit")
    return vertex + offset


def token(points: Points, p: int, kind: str, offset: int = 1) -> str:
    """The token of a crossing point."""
    ends = [sorted(label(v, offset) for v in points.edges[e]) for e in points.parts[p]]
    digits = sorted(x for e in ends for x in e) if kind == "four" else [x for e in sorted(ends) for x in e]
    return "".join(map(str, digits))


def label_table(spark: SparkSession, points: Points, offset: int = 1) -> DataFrame:
    """point, crossing token and four-vertex token of every possible crossing."""
    rows = [(p, *(token(points, p, k, offset) for k in KINDS)) for p in sorted(points.parts)]
    return spark.createDataFrame(rows, "point int, crossing string, four string")


def _tokens(points: Column, census: Census, kind: str) -> Column:
    names = F.lit([token(census.points, p, kind) for p in sorted(census.points.parts)])
    return F.array_sort(F.array_distinct(F.transform(points, lambda p: F.element_at(names, p - (census.m + census.n) + 1))))


def flag_text(tokens: Column, colors: tuple[int, ...]) -> Column:
    head = f"{len(colors)} 0 {' '.join(map(str, colors))}"
    return F.concat_ws(" ", F.lit(head), F.size(tokens).cast("string"), F.when(F.size(tokens) > 0, F.array_join(tokens, " ")))


def swapped_points(census: Census) -> list[int]:
    """Where each crossing goes if the sides change places in order (m = n)."""
    m = census.m
    return list(census.points.relabeling({v: (v + m) % (2 * m) for v in range(2 * m)})[2 * m :])


def exported(sets: DataFrame, census: Census) -> DataFrame:
    """Labeled flags of all classes, once, or in both orientations if the sides are alike: kind, flag, tokens."""
    points = F.col("points")
    ways = [points]
    if census.m == census.n:
        move = F.lit(swapped_points(census))
        ways.append(F.array_sort(F.transform(points, lambda p: F.element_at(move, p - 2 * census.m + 1))))
    x = sets.select(F.explode(F.array(*ways)).alias("points"))
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), _tokens(F.col("points"), census, k).alias("tokens")) for k in KINDS))
    return x.select(F.inline(rows)).withColumn("flag", flag_text(F.col("tokens"), census.colors))


def labeled(rows: DataFrame) -> DataFrame:
    """Distinct labeled flags."""
    return rows.select("kind", "flag", "tokens").dropDuplicates(["kind", "flag"])


def token_moves(census: Census, kind: str, blind: bool) -> tuple[list[str], list[list[int]]]:
    """All tokens of a kind, sorted, and for each permutation where each token goes."""
    points = census.points
    of = {p: token(points, p, kind) for p in points.parts}
    names = sorted(set(of.values()))
    at = {t: i for i, t in enumerate(names)}
    moves = []
    for p in census.color_group(blind):
        move = points.relabeling(dict(enumerate(p)))
        row = [0] * len(names)
        for q, t in of.items():
            row[at[t]] = at[of[move[q]]]
        moves.append(row)
    return names, moves


def flag_classes(flags: DataFrame, census: Census, kind: str, blind: bool) -> DataFrame:
    """One row per class of flags under relabelings that keep the colors (blind: or exchange them): canon, flag, tokens, flags."""
    names, moves = token_moves(census, kind, blind)
    ids = F.transform("tokens", lambda t: F.array_position(F.lit(names), t).cast("int"))
    canon = F.array_min(F.transform(F.lit(moves), lambda move: F.array_sort(F.transform(ids, lambda i: F.element_at(move, i)))))
    x = flags.where(F.col("kind") == kind).withColumn("canon", canon)
    return x.groupBy("canon").agg(F.min("flag").alias("flag"), F.min_by("tokens", "flag").alias("tokens"), F.count("*").alias("flags")).withColumn("kind", F.lit(kind))


def flag_class_counts(flags: DataFrame, census: Census, kind: str) -> DataFrame:
    """color_preserving and color_blind numbers of classes; the blind ones are made of the others."""
    kept = flag_classes(flags, census, kind, False)
    if census.m != census.n:
        return kept.agg(F.count("*").alias("color_preserving"), F.count("*").alias("color_blind"))
    both = flag_classes(kept, census, kind, True)
    return kept.agg(F.count("*").alias("color_preserving")).join(both.agg(F.count("*").alias("color_blind")))


def flag_bucket(flag: Column, blind: bool, digits: int = 2) -> Column:
    """First hexadecimal digits of a hash of what relabeling keeps: number of tokens, and each color's sorted degrees."""
    field = F.split(flag, " ")
    n = F.element_at(field, 1).cast("int")
    colors = F.slice(field, 3, n)
    tokens = F.slice(field, n + 4, F.size(field))
    degree = F.transform(F.sequence(F.lit(1), n), lambda v: F.size(F.filter(tokens, lambda t: F.contains(t, v.cast("string")))))
    pairs = F.zip_with(colors, degree, lambda c, d: F.struct(c.alias("c"), d.alias("d")))
    of = lambda c: F.array_join(F.transform(F.array_sort(F.transform(F.filter(pairs, lambda p: p["c"] == c), lambda p: p["d"])), lambda d: d.cast("string")), ",")
    shades = F.array_sort(F.array_distinct(colors))
    profile = F.array_sort(F.transform(shades, of)) if blind else F.transform(shades, lambda c: F.concat_ws(":", c, of(c)))
    return F.substring(F.sha2(F.concat_ws("|", F.size(tokens).cast("string"), F.array_join(profile, ";")), 256), 1, digits)


def simple_invariant(flag: Column) -> Column:
    """A flag up to its number of tokens."""
    field = F.split(flag, " ")
    return F.array_join(F.slice(field, 1, F.element_at(field, 1).cast("int") + 3), " ")

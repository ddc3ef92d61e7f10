"""The census: stages of expand, shuffle by canonical form, distinct; a Parquet table after each stage.

A row is a class: form (packed canonical drawing, key and representative at once), its crossing count and the sorted crossing
counts of its paths. Expansion is a flat-map in Arrow batches that removes its own repeats as far as a bounded memory goes;
grouping by form is a hash aggregate with partial aggregation, which neither skew by crossing count nor repeats of one form
unbalance. Tables end the lineage, give resumption, and survive lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarflow.functions import canonical
from planarflow.functions.drawing import Drawing, extend_stage, seeds, stage_crossings
from planarflow.plans.graph import Census
from planarflow.sources.folders import written

#: Distinct forms that a task holds before it passes them on.
FLUSH = 20_000
CLASS = "form binary, crossings int, path_crossings array<int>"
_ARROW = pa.schema([("form", pa.binary()), ("crossings", pa.int32()), ("path_crossings", pa.list_(pa.int32()))])


@lru_cache(maxsize=8)
def census_of(m: int, n: int) -> Census:
    return Census(m, n)


def missing_faces(d: Drawing) -> int:
    """Faces that Euler's formula asks for beyond those known."""
    v = len({p for _, path in d.paths for p in path})
    return sum(len(path) - 1 for _, path in d.paths) - v + 2 - len(d.faces)


def _row(form: bytes, d: Drawing, vertices: int) -> tuple:
    return form, len(d.crossings(vertices)), canonical.path_crossing_counts(d)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def seed_classes(spark: SparkSession, m: int, n: int) -> DataFrame:
    """The two drawings of the base cycle."""
    c = census_of(m, n)
    can = canonical.canonizer(m, n, -1)
    rows = {(f := can.form(d)): _row(f, d, m + n) for d in seeds(c)}
    return spark.createDataFrame(list(rows.values()), CLASS)


def expand(frontier: DataFrame, m: int, n: int, stage: int) -> DataFrame:
    """Canonical forms of all drawings that a stage makes of the frontier's, most repeats within a task removed.

    The planar seed's two faces coincide, so drawings made from it can lack a face. Those that have crossings come from the
    other seed as well, complete, and are dropped here; planar ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = census_of(m, n)
        can = canonical.canonizer(m, n, stage)
        held: dict[bytes, tuple] = {}
        for batch in batches:
            for value in batch.column(0):
                for child in extend_stage(c.points, canonical.unpack(value.as_py()), c.stages[stage]):
                    if missing_faces(child) and child.crossings(m + n):
                        continue
                    form = can.form(child)
                    if form not in held:
                        held[form] = _row(form, child, m + n)
                if len(held) >= FLUSH:
                    yield _batch(list(held.values()))
                    held.clear()
        yield _batch(list(held.values()))

    return frontier.select("form").mapInArrow(run, CLASS)


def reduce_classes(candidates: DataFrame) -> DataFrame:
    """One row per canonical form."""
    return candidates.groupBy("form").agg(F.min("crossings").alias("crossings"), F.min("path_crossings").alias("path_crossings"))


def stage_path(root: str, m: int, n: int, stage: int) -> str:
    return f"{root}/K_{m}_{n}/stage={stage}"


def _done(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def classes(spark: SparkSession, m: int, n: int, root: str | None = None, tasks: int | None = None, stages: int | None = None) -> DataFrame:
    """Classes of K(m,n) after all stages or the first few.

    Stages that a table under root exists for are not run again; tables are partitioned by crossing count. Without root, intermediate
    classes are tables in the shared folder that go when the process ends."""
    frontier = seed_classes(spark, m, n)
    tasks = tasks or max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = len(census_of(m, n).stages) if stages is None else stages
    for stage in range(last):
        path = root and stage_path(root, m, n, stage)
        if path and _done(spark, path):
            frontier = spark.read.schema(CLASS).parquet(path)
            continue
        # Parents differ much in cost and are few at first: deal them out singly.
        found = reduce_classes(expand(frontier.repartition(tasks), m, n, stage))
        if path:
            # Rows of a crossing count go to as many tasks as their bytes need.
            found.hint("rebalance", "crossings").write.mode("overwrite").partitionBy("crossings").parquet(path)
            frontier = spark.read.schema(CLASS).parquet(path)
        else:
            frontier = written(found, "classes") if stage + 1 < last else found
    return frontier


def final_crossing_sets(spark: SparkSession, parents: DataFrame, m: int, n: int) -> DataFrame:
    """Distinct crossing sets (array of point numbers) of the last stage, for which its last step builds no drawings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = census_of(m, n)
        for batch in batches:
            for value in batch.column(0):
                sets = stage_crossings(c.points, canonical.unpack(value.as_py()), c.stages[-1])
                yield pa.RecordBatch.from_arrays([pa.array([sorted(s) for s in sets], pa.list_(pa.int32()))], names=["points"])

    return parents.select("form").mapInArrow(run, "points array<int>").distinct()


def crossing_sets(found: DataFrame, m: int, n: int) -> DataFrame:
    """form and points (sorted crossing points) of classes, and what the side swap does to them: swap_candidate, swap_fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = census_of(m, n)
        for batch in batches:
            drawings = [canonical.unpack(v.as_py()) for v in batch.column(0)]
            swaps = [canonical.side_swap(d, c) for d in drawings]
            columns = [batch.column(0), pa.array([list(d.crossings(m + n)) for d in drawings], pa.list_(pa.int32())), pa.array([s[0] for s in swaps]), pa.array([s[1] for s in swaps])]
            yield pa.RecordBatch.from_arrays(columns, names=["form", "points", "swap_candidate", "swap_fixed"])

    return found.select("form").mapInArrow(run, "form binary, points array<int>, swap_candidate boolean, swap_fixed boolean")


def strong_classes(sets: DataFrame, m: int, n: int) -> DataFrame:
    """One row: classes that keep colors, classes blind to them, side swap counts (null unless m = n).

    A class that the side swap does not fix counts twice if colors are kept."""
    square = m == n
    count = F.count("*")
    fixed = F.count_if("swap_fixed")
    null = F.lit(None).cast("long")
    return sets.agg(
        (2 * count - fixed if square else count).alias("color_preserving"),
        count.alias("color_blind"),
        (F.count_if("swap_candidate") if square else null).alias("side_swap_candidates"),
        (fixed if square else null).alias("fixed_by_side_swap"),
    )

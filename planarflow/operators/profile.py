"""What an expansion does, as rows: routes, infeasible ones, drawings and time of each step, by parent."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from planarflow.functions import canonical
from planarflow.functions.drawing import Extender
from planarflow.operators.census import census_of

_NAMES = ("step", "parents", "routes", "infeasible", "drawings", "distinct", "seconds")


def profile_stage(frontier: DataFrame, m: int, n: int, stage: int) -> DataFrame:
    """form and, for each step of the stage, counts over the drawings that the form's earlier steps gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = census_of(m, n)
        for batch in batches:
            for value in batch.column(0):
                held = {canonical.unpack(value.as_py())}
                rows = []
                for k, step in enumerate(c.stages[stage].steps):
                    began, routes, lost, made, after = time.perf_counter(), 0, 0, 0, set()
                    for d in held:
                        x = Extender(c.points, d, step)
                        for route in x.routes():
                            routes += 1
                            lost += x.face_choices(*route) is None
                        for child in x.drawings():
                            made += 1
                            after.add(child)
                    rows.append((k, len(held), routes, lost, made, len(after), time.perf_counter() - began))
                    held = after
                kinds = [pa.int32(), *[pa.int64()] * 5, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([value.as_py()] * len(rows), pa.binary()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["form", *_NAMES])

    return frontier.select("form").mapInArrow(run, "form binary, step int, parents long, routes long, infeasible long, drawings long, distinct long, seconds double")


def step_totals(profile: DataFrame) -> DataFrame:
    """Sums and maxima over parents by step."""
    return profile.groupBy("step").agg(*(F.sum(c).alias(c) for c in _NAMES[1:]), F.max("drawings").alias("most_drawings"), F.max("seconds").alias("longest"))


class Measures:
    """Sums and extremes that the steps of a plan take while its result is written, without a pass of their own.

        steps = Measures()
        rows = steps.at(rows, "read", rows_read=F.count("*"))
        rows.where(...).write.parquet(path)
        steps.found()

    One action runs the plan; a step that the plan drops, as Spark does with what has no rows, measured nothing and gives nulls."""

    def __init__(self) -> None:
        self._steps: list[tuple[str, tuple[str, ...]]] = []
        self._seen: dict[str, Observation] = {}

    def at(self, df: DataFrame, step: str, **measures: Column) -> DataFrame:
        """df, measured where it stands."""
        if any(step == name for name, _ in self._steps):
            raise ValueError(f"step {step} is measured already")
        self._steps.append((step, tuple(measures)))
        self._seen[step] = Observation(step)
        return df.observe(self._seen[step], *(c.alias(k) for k, c in measures.items()))

    def found(self) -> dict[str, object]:
        """All measures by name; waits for the action, which must have been started."""
        out: dict[str, object] = {}
        for step, names in self._steps:
            try:
                held = self._seen[step].get
            except Py4JJavaError:  # no such step was run
                held = {}
            out |= {n: held.get(n) for n in names}
        return out

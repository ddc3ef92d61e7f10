"""Classes, candidates and flags as files of other formats: gzip record files, JSON lines, flag texts.

Files are read by Spark's own readers (any store), decoded in Arrow batches, and written by its writers; framed gzip files
travel as one binary row each.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarflow.functions import canonical
from planarflow.operators.census import census_of
from planarflow.sources import codec


def read_record_files(spark: SparkSession, path: str) -> DataFrame:
    """path and record of every record of gzip record files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gds.gz").option("recursiveFileLookup", True).load(path)
    return records_of(files)


def records_of(files: DataFrame) -> DataFrame:
    """path and record of every record of files (path, content); they are unzipped as they are read, some records at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                with gzip.open(pa.BufferReader(content.as_buffer()), "rb") as f:
                    records = codec.stream_records(f)
                    while held := list(islice(records, 4096)):
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(held), pa.string()), pa.array(held, pa.binary())], names=["path", "record"])

    return files.select("path", "content").mapInArrow(run, "path string, record binary")


def crossing_count_of(path):
    """The count that a file's folder crossings-N names, else null."""
    return F.nullif(F.regexp_extract(path, r"/crossings-(\d+)/", 1), F.lit("")).cast("int")


def pack_record_files(records: DataFrame, per_file: int = 5_000) -> DataFrame:
    """name and content of gzip record files that hold the column record, per_file at most in each; nulls are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, per_file):
                held = bytearray()
                rows = [r for r in batch.column(0).slice(at, per_file).to_pylist() if r is not None]
                for r in rows:
                    codec.put_varint(len(r), held)
                    held += r
                data = gzip.compress(bytes(held), mtime=0)
                yield pa.RecordBatch.from_arrays([pa.array([f"{codec.digest(data)[:16]}.gds.gz"]), pa.array([data], pa.binary()), pa.array([len(rows)], pa.int64())], names=["name", "content", "records"])

    return records.select("record").mapInArrow(run, "name string, content binary, records long")


def write_record_files(records: DataFrame, path: str, per_file: int = 5_000) -> int:
    """Write gzip record files under path, a folder that all executors reach, or a store that pyarrow opens; returns their number.

    Files are named by their content and moved when they are whole, so a task that runs again writes the same files."""
    target = path if "://" in path else Path(path).absolute().as_uri()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = FileSystem.from_uri(target)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(beside, compression=None) as out:
                    out.write(content)
                store.move(beside, f"{folder}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return pack_record_files(records, per_file).select("name", "content").mapInArrow(run, "name string").distinct().count()


def _by_form(df: DataFrame, kind: str, make) -> DataFrame:
    spark_type = {"binary": pa.binary(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [make(canonical.unpack(v.as_py())) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, spark_type)], names=["form", "value"])

    return df.select("form").mapInArrow(run, f"form binary, value {kind}")


def compact_records(classes: DataFrame, m: int, n: int, stage: int) -> DataFrame:
    """form and its compact record."""
    points = census_of(m, n).points
    return _by_form(classes, "binary", lambda d: codec.encode(d, stage, points)).withColumnRenamed("value", "record")


def reduced_records(classes: DataFrame, m: int, n: int, stage: int) -> DataFrame:
    """Reduced shard records: hash of the form twice, then the compact record."""
    key = F.sha2("form", 256)
    return compact_records(classes, m, n, stage).select(F.concat(F.encode(F.concat(key, key), "utf-8"), "record").alias("record"))


def json_drawings(classes: DataFrame, m: int, n: int) -> DataFrame:
    """form and its expanded JSON."""
    points = census_of(m, n).points
    return _by_form(classes, "string", lambda d: codec.to_json(d, points)).withColumnRenamed("value", "json")


def classes_of_records(records: DataFrame, m: int, n: int, stage: int) -> DataFrame:
    """Canonical forms of compact records (column record), repeats removed: an import of another run's drawings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = census_of(m, n)
        can, edges = canonical.canonizer(m, n, stage), c.stage_edges(stage)
        for batch in batches:
            forms = [can.form(codec.decode(v.as_py(), c.points, edges)) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.binary())], names=["form"])

    return records.select("record").mapInArrow(run, "form binary").distinct()


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """flag, kind-free, from text files of flags with or without a bucket before a tab."""
    line = F.col("value")
    return spark.read.text(path).select(F.element_at(F.split(line, "\t"), -1).alias("flag"))

"""Files as chunks of bytes: digests and line counts of files of any size, without a whole file in one cell or task.

    spark.dataSource.register(ChunkSource)
    file_facts(spark.read.format("chunks").load(path))

A chunk's row has file, place (the chunk's number), size, the SHA-256 of its bytes, its line ends, and whether it ends with one. A
file's digest is the SHA-256 of its chunks' digests, in order, so it depends on the size of chunks, which is part of what is
compared. Paths are files or folders, local or in stores that pyarrow opens; files whose names begin with a dot or an underscore are
left out, as Spark's readers do.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from planarflow.sources.record_source import open_store

CHUNK_BYTES, STEP_BYTES = 64 << 20, 1 << 20
#: Chunks that one task reads at most.
PER_TASK = 16


@dataclass
class Chunks(InputPartition):
    file: str
    size: int
    first: int
    count: int


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunkBytes", CHUNK_BYTES))

    def partitions(self) -> list[InputPartition]:
        store, root = open_store(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == FileType.File else [f for f in store.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File and not any(p[0] in "._" for p in f.path.removeprefix(root).strip("/").split("/"))]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            chunks = max(1, -(-f.size // self.chunk))  # an empty file is one empty chunk
            out += [Chunks(f.path, f.size, k, min(PER_TASK, chunks - k)) for k in range(0, chunks, PER_TASK)]
        return out or [Chunks("", 0, 0, 0)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        rows = []
        if partition.count:
            store, _ = open_store(self.path)
            with store.open_input_file(partition.file) as f:
                for k in range(partition.first, partition.first + partition.count):
                    f.seek(k * self.chunk)
                    left = size = min(self.chunk, partition.size - k * self.chunk)
                    digest, ends, last = hashlib.sha256(), 0, b""
                    while left:
                        data = f.read(min(STEP_BYTES, left))
                        if not data:
                            raise OSError(f"{partition.file} is shorter than it was")
                        digest.update(data)
                        ends, last, left = ends + data.count(b"\n"), data[-1:], left - len(data)
                    rows.append((posixpath.basename(partition.file), partition.file, k, size, digest.hexdigest(), ends, last == b"\n"))
        if rows:
            names = ("name", "file", "place", "size", "sha256", "line_ends", "ended")
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(names))


class ChunkSource(DataSource):
    """The format "chunks". Options: path, chunkBytes."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return "name string, file string, place long, size long, sha256 string, line_ends long, ended boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChunkReader(self.options)


def file_facts(chunks: DataFrame) -> DataFrame:
    """file, size, lines (a last one need not be ended), chunks, and sha256 over the chunks' digests."""
    digests = F.transform(F.sort_array(F.collect_list(F.struct("place", "sha256"))), lambda c: c["sha256"])
    x = chunks.groupBy("file").agg(F.sum("size").alias("size"), F.sum("line_ends").alias("_ends"), F.max_by("ended", "place").alias("_ended"), F.count("*").alias("chunks"), F.sha2(F.array_join(digests, ""), 256).alias("sha256"))
    return x.select("file", "size", (F.col("_ends") + F.when((F.col("size") > 0) & ~F.col("_ended"), 1).otherwise(0)).alias("lines"), "chunks", "sha256")

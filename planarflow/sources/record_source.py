"""Gzip record files as a data source of Spark: spark.read.format("records"), df.write.format("records"), and streams of both.

    spark.dataSource.register(RecordSource)
    df.select("record", "bucket").write.format("records").option("key", "bucket").mode("append").save(path)
    spark.read.format("records").options(key="bucket", keys='["0f"]').load(path)

A file is a gzip stream of records, each behind its length as a varint. Reading gives record, file and place (the record's number in
its file), and with a key the value that the file's folder key=value names, as text. A file is one task's work and is unzipped as it
is read, so a cell holds one record, never a file. The option keys, a JSON list, leaves the files of all other keys unopened. There
is no pushFilters: in Spark 4.1.2 the filters of one query stay with the DataFrame and take rows from its next query.

Tasks write under _temporary; a file begins anew at a byte limit and where the key changes, so rows should come sorted by it. The
driver moves the files into place when all tasks have ended, and lists them in _commits: a task or a write that was stopped leaves
nothing that readers see. A stream reads commit after commit; a stream's batch that is run again after its commit is dropped.

A null record is written as an empty one, a null key as the folder of Hive's name for it. An empty table writes a commit without
files. One write at a time may commit to a folder. Paths are local ones or URIs of stores that pyarrow opens; others, which only Spark
reaches, are read by files.read_record_files.
"""

from __future__ import annotations

import gzip
import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from planarflow.sources import codec

SUFFIX, NONE = ".gds.gz", "__HIVE_DEFAULT_PARTITION__"
COMMITS, HALF = "_commits", "_temporary"
#: Unzipped bytes after which a file ends, and of a batch that Spark gets.
FILE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20


def open_store(path: str) -> tuple[FileSystem, str]:
    """The file system and the path in it."""
    if path.startswith("file:"):
        path = path.removeprefix("file:").replace("//", "", 1) if path.startswith("file://") else path.removeprefix("file:")
    return FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri())


def key_of(file: str, key: str | None) -> str | None:
    """The value that a folder key=value above a file names."""
    for part in posixpath.dirname(file).split("/"):
        if key and part.startswith(f"{key}="):
            value = unquote(part.removeprefix(f"{key}="))
            return None if value == NONE else value
    return None


@dataclass
class RecordFile(InputPartition):
    file: str
    key: str | None


@dataclass
class Written(WriterCommitMessage):
    #: (where a file lies, where it belongs) below the folder.
    files: list[tuple[str, str]]


class _Folder:
    """What readers and writers of one folder share."""

    def __init__(self, options: dict, schema: StructType | None = None):
        if "path" not in options:
            raise ValueError("record files need a path")
        self.path, self.key = options["path"], options.get("key")
        self.limit = int(options.get("fileBytes", FILE_BYTES))
        self.schema = schema

    def commits(self) -> list[int]:
        store, root = open_store(self.path)
        found = store.get_file_info(FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
        return sorted(int(posixpath.basename(f.path).removesuffix(".json")) for f in found if f.path.endswith(".json"))

    def listed(self, commit: int) -> list[str]:
        store, root = open_store(self.path)
        with store.open_input_stream(f"{root}/{COMMITS}/{commit:012}.json", compression=None) as f:
            return json.loads(f.read())

    def files(self) -> list[str]:
        """Files below the folder, but those that are being written."""
        store, root = open_store(self.path)
        if store.get_file_info(root).type == FileType.File:
            return [""]
        below = (f.path.removeprefix(root).lstrip("/") for f in store.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File)
        return sorted(f for f in below if f.endswith(SUFFIX) and not any(p[0] in "._" for p in f.split("/")))

    def read(self, partition: RecordFile) -> Iterator[pa.RecordBatch]:
        store, root = open_store(self.path)
        name = f"{root}/{partition.file}".rstrip("/")
        place = 0
        with store.open_input_file(name) as raw, gzip.open(raw, "rb") as f:
            held, size = [], 0
            for record in codec.stream_records(f):
                held.append(record)
                size += len(record)
                if size >= BATCH_BYTES or len(held) >= 4096:
                    yield self._batch(held, name, place, partition.key)
                    place, held, size = place + len(held), [], 0
            if held:
                yield self._batch(held, name, place, partition.key)

    def _batch(self, held: list[bytes], name: str, place: int, key: str | None) -> pa.RecordBatch:
        n = len(held)
        columns = {"record": pa.array(held, pa.binary()), "file": pa.array([name] * n, pa.string()), "place": pa.array(range(place, place + n), pa.int64())}
        if self.key:
            columns[self.key] = pa.array([key] * n, pa.string())
        return pa.RecordBatch.from_pydict(columns)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_store(self.path)
        store.create_dir(f"{root}/{HALF}", recursive=True)
        written: list[tuple[str, str]] = []
        out, open_key, size = None, None, 0
        try:
            for batch in batches:
                keys = batch.column(self.key).to_pylist() if self.key else [None] * len(batch)
                for record, key in zip(batch.column("record"), keys):
                    data = record.as_py() or b""
                    if out is None or key != open_key or size >= self.limit:
                        if out:
                            out.close()
                            raw.close()
                        name = f"{uuid.uuid4().hex}{SUFFIX}"
                        folder = f"{self.key}={NONE if key is None else quote(key, safe='')}/" if self.key else ""
                        written.append((f"{HALF}/{name}", f"{folder}{name}"))
                        raw = store.open_output_stream(f"{root}/{HALF}/{name}", compression=None)
                        out, open_key, size = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0), key, 0
                    head = bytearray()
                    codec.put_varint(len(data), head)
                    out.write(head + data)
                    size += len(head) + len(data)
        finally:
            if out:
                out.close()
                raw.close()
        return Written(written)

    def put(self, messages: Sequence[Written | None], commit: int) -> None:
        """Move the files into place, then list them under a name that appears at once."""
        store, root = open_store(self.path)
        moves = [move for m in messages if m for move in m.files]
        for a, b in moves:
            store.create_dir(posixpath.dirname(f"{root}/{b}"), recursive=True)
            store.move(f"{root}/{a}", f"{root}/{b}")
        store.create_dir(f"{root}/{COMMITS}", recursive=True)
        beside = f"{root}/{COMMITS}/.{uuid.uuid4().hex}"
        with store.open_output_stream(beside, compression=None) as f:
            f.write(json.dumps(sorted(b for _, b in moves)).encode())
        store.move(beside, f"{root}/{COMMITS}/{commit:012}.json")

    def drop(self, messages: Sequence[Written | None]) -> None:
        store, root = open_store(self.path)
        for m in messages:
            for a, _ in m.files if m else ():
                if store.get_file_info(f"{root}/{a}").type == FileType.File:
                    store.delete_file(f"{root}/{a}")

    def clear(self) -> None:
        """Delete files and commits; what is being written stays."""
        store, root = open_store(self.path)
        for f in self.files():
            store.delete_file(f"{root}/{f}")
        if self.commits():
            store.delete_dir(f"{root}/{COMMITS}")


class RecordReader(_Folder, DataSourceReader):
    def __init__(self, options: dict):
        _Folder.__init__(self, options)
        self.only = json.loads(options["keys"]) if "keys" in options else None

    def partitions(self) -> list[InputPartition]:
        found = [RecordFile(f, key_of(f, self.key)) for f in self.files()]
        return [p for p in found if self.only is None or p.key in self.only] or [RecordFile("", NONE)]

    def read(self, partition: RecordFile) -> Iterator[pa.RecordBatch]:
        if partition.key == NONE:  # Spark needs a partition where there is no file
            return iter(())
        return _Folder.read(self, partition)


class RecordWriter(_Folder, DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        _Folder.__init__(self, options, schema)
        self.overwrite = overwrite

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite:
            self.clear()
        self.put(messages, max(self.commits(), default=-1) + 1)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.drop(messages)


class RecordStreamReader(_Folder, DataSourceStreamReader):
    def __init__(self, options: dict):
        _Folder.__init__(self, options)

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        """Commits come in ascending order; a stream may leave numbers out."""
        return {"commits": max(self.commits(), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [RecordFile(f, key_of(f, self.key)) for c in self.commits() if start["commits"] <= c < end["commits"] for f in self.listed(c)]

    def read(self, partition: RecordFile) -> Iterator[pa.RecordBatch]:
        return _Folder.read(self, partition)


class RecordStreamWriter(_Folder, DataSourceStreamArrowWriter):
    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        if batchId in self.commits():
            self.drop(messages)
        else:
            self.put(messages, batchId)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self.drop(messages)


class RecordSource(DataSource):
    """The format "records". Options: path, key, keys, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        key = self.options.get("key")
        return "record binary, file string, place long" + (f", `{key}` string" if key else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(self.options, schema, overwrite)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RecordStreamReader(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return RecordStreamWriter(self.options, schema)

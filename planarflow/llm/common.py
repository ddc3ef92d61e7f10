"""Helpers that the operators of this subpackage share: tables, written cuts of the lineage, text hashing."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step handles; bounds a Python worker's temporaries.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch: a batch of very long texts then holds fewer rows.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run here (tests)."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return str(known.get())
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="planarflow-"))
    return str(sc._jsc.sc().getCheckpointDir().get())


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get by bytes, not by rows alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) != str(BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Give freed memory back to the system, so that a reused Python worker does not keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has gone; the folder goes with it
        pass


#: Tables that cut() made in each open scratch().
_open: list[list[DataFrame]] = []


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: ends its lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._planarflow_path = path
    atexit.register(_delete, spark, path)
    if _open:
        _open[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that cut() makes meanwhile at the end, but those given to what this yields."""
    kept: list[DataFrame] = []
    _open.append([])

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        mine = _open.pop()
        release(*(df for df in mine if all(df is not k for k in kept)))
        if _open:
            _open[-1].extend(kept)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder when the process ends."""
    atexit.register(_delete, spark, path)


def release(*frames: DataFrame) -> None:
    """Delete tables made by cut() that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_planarflow_path", None):
            _delete(df.sparkSession, path)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies: PLANARFLOW_TOKENIZERS, else the installed package."""
    if folder := os.environ.get("PLANARFLOW_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


# --- vectorised words ---------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def views(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each text of a column, without a copy; empty for nulls."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].tolist()
    held = memoryview(data) if data is not None else memoryview(b"")
    return [held[a:b] for a, b in zip(ends, ends[1:])]


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about limit bytes each; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def windows(text: memoryview | bytes, limit: int = SLICE_BYTES, gaps: np.ndarray = _SPACE) -> Iterator[memoryview | bytes]:
    """Parts of a text that end behind white space (or other gaps), of at most limit bytes where there is any."""
    at = 0
    while len(text) - at > limit:
        end, step = 0, limit
        while not end and at + step < len(text):
            space = np.flatnonzero(gaps[np.frombuffer(text, np.uint8, step if step == limit else limit, at + step - limit)])
            if len(space):
                end = at + step - limit + 1 + int(space[-1] if step == limit else space[0])
            step = min(step + limit, max(step + 1, len(text) - at))
        if not end:
            break
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def _word_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the sum of its bytes' values times the powers of a base; words of more than a slice are summed in parts."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_BYTES, side="right")))
        a, b = int(starts[first]), int(ends[last - 1])
        if b - a > SLICE_BYTES:
            power, scale, total = _powers(SLICE_BYTES), np.uint64(1), np.uint64(0)
            with np.errstate(over="ignore"):
                for k in range(a, b, SLICE_BYTES):
                    part = data[k : min(b, k + SLICE_BYTES)].astype(np.uint64) + np.uint64(1)
                    total += scale * (part * power[: len(part)]).sum(dtype=np.uint64)
                    scale *= power[-1] * _BASE
            out[first] = total
        else:
            own, long = starts[first:last] - a, int((ends[first:last] - starts[first:last]).max())
            where = np.arange(b - a, dtype=np.int64)
            where -= np.repeat(own, np.diff(np.r_[own, b - a]))
            body = (data[a:b].astype(np.uint64) + np.uint64(1)) * _powers(long)[np.minimum(where, long - 1)]
            body[where >= np.repeat(ends[first:last] - starts[first:last], np.diff(np.r_[own, b - a]))] = 0
            out[first:last] = np.add.reduceat(body, own)
        first = last
    return out


def word_hashes(texts: list, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, A-Z lower-cased: 64-bit hash, text number, start, end, and the bytes they lie in.

    A word is a run of bytes for which separator is False; hashes depend on the bytes alone."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    gap = separator[data]
    gap_at = np.zeros(len(data) + 1, bool)
    gap_at[0] = True
    np.copyto(gap_at[1:], gap)
    starts = np.flatnonzero(gap_at[:-1] & ~gap)
    ends = np.flatnonzero(~gap_at[:-1] & gap) if len(starts) else starts
    ends = ends[ends > (starts[0] if len(starts) else 0)]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, data
    h = mix64(_word_sums(data, starts, ends) ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(bounds, starts, side="right"), starts, ends, data


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width words of one text, in blocks."""
    out = np.zeros(len(h) - width + 1, np.uint64)
    for a in range(0, len(out), SLICE_BYTES):
        part = out[a : a + SLICE_BYTES]
        for k in range(width):
            part[:] = mix64(part * _BASE + h[a + k : a + k + len(part)] + np.uint64(k + 1))
    return out


def shingle_hashes(texts: list, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, hash) of the texts' shingles of width words, sorted; with fewer words, the whole sequence is one.

    A long text that stands alone is read in windows: what is held besides it is two words of 8 bytes for each of its words."""
    if len(texts) == 1 and len(texts[0]) > 2 * SLICE_BYTES:
        h = np.concatenate([word_hashes([w])[0] for w in windows(texts[0])])
        if len(h) >= width:
            acc = _rolled(h, width)
            del h
            acc.sort()
            new = np.ones(len(acc), bool)
            np.not_equal(acc[1:], acc[:-1], out=new[1:])
            acc = acc[new]
            return np.broadcast_to(np.int64(0), len(acc)), acc
    h, doc, *_ = word_hashes(texts)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    place = np.arange(n) - first[doc]
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - k)] = h[k:]
        inside = place + k < count[doc]
        acc = np.where(inside, mix64(acc * _BASE + part + np.uint64(k + 1)), acc)
    keep = (place + width <= count[doc]) | ((count[doc] < width) & (place == 0))
    doc, acc = doc[keep], acc[keep]
    order = np.lexsort((acc, doc))
    doc, acc = doc[order], acc[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (acc[1:] != acc[:-1])]
    return doc[new], acc[new]

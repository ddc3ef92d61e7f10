"""Token ids in files: canonical length-limited Huffman codes, independent blocks with bit-offset checkpoints.

Format, one row per block in a Parquet table (Spark's writers reach any store): part and block give the order; doc_ids and
doc_tokens list the documents that lie in the block whole; start is the number of the part's ids before the block; words are
the bit stream as big-endian 32-bit words; marks are the bit offsets of every STRIDE-th id. The code is canonical, so the
lengths of all symbols describe it; they are in a second table, `<path>/code`. Any block can be decoded alone, and within a
block every mark starts an independent lane, so that one table lookup decodes an id in each lane at once.

Rows are dealt by ranges of (doc_id, hash of the ids, row), as many as the ids need, so that a doc_id that many rows share is
divided as well. A very long text makes a block of its own length; it is encoded, packed and decoded in windows.

Null texts count as empty: the end id alone. Rows with a null doc_id come first; repeated doc_ids stay beside each other. An empty table writes no blocks and reads back as no rows. Further columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, release, shared_dir, small_batches, tokenizer_path, trim, views, windows
from .word_bpe import STEP_BYTES, steps, tokenizer

#: Ids of a block before it ends with its document; ids between two marks; longest code in bits.
BLOCK_IDS, STRIDE, MAX_BITS = 1 << 16, 256, 16
#: Bytes of ids for a range, and ids that are packed or decoded at once.
RANGE_BYTES, WINDOW = 1 << 27, 1 << 20
_CUTS = np.zeros(256, bool)
_CUTS[[0x20, 0x0A]] = True


# --- code -----------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits for symbols with counts (package-merge); 0 where the count is 0."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    # Each level holds the leaves and the pairs of the level below, by weight; only whether an item is a leaf is remembered.
    levels: list[np.ndarray] = []
    weight = leaf
    is_leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        m = len(weight) // 2
        pairs = weight[0 : 2 * m : 2] + weight[1 : 2 * m : 2]
        both = np.concatenate([leaf, pairs])
        by = np.argsort(both, kind="stable")
        weight, is_leaf = both[by], by < n
    levels.append(is_leaf)
    taken = 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:taken].sum())
        out[order[:leaves]] += 1
        taken = 2 * (taken - leaves)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    steps = lengths[order]
    for length in np.unique(steps):
        at = order[steps == length]
        code <<= int(length) - last
        codes[at] = code + np.arange(len(at))
        code += len(at)
        last = int(length)
    return codes


def decode_table(lengths: np.ndarray, bits: int = MAX_BITS) -> np.ndarray:
    """For every bit string of the given size, symbol << 8 | length of the code that it begins with."""
    out = np.zeros(1 << bits, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (bits - lengths[order])
    filled = np.repeat(order << 8 | lengths[order], span)
    out[: len(filled)] = filled
    return out


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream of ids in big-endian 32-bit words, and the bit offset of every STRIDE-th id."""
    if len(ids) > WINDOW:
        parts = [pack(ids[a : a + WINDOW], codes, lengths) for a in range(0, len(ids), WINDOW)]
        first = np.cumsum([0, *(8 * len(w) for w, _ in parts[:-1])])
        return b"".join(w for w, _ in parts), np.concatenate([m + f for (_, m), f in zip(parts, first)])
    ids = ids.astype(np.int64)
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    words = int(ends[-1] + 31) // 32 + 2
    slot, shift = at >> 5, 64 - (at & 31) - size
    value = codes[ids] << shift
    total = np.bincount(slot, weights=(value >> 32).astype(np.float64), minlength=words)
    total += np.bincount(slot + 1, weights=(value & 0xFFFFFFFF).astype(np.float64), minlength=words)
    return total.astype(np.int64).astype(">u4").tobytes(), at[::STRIDE].astype(np.int64)


def unpack(blocks: list[tuple[bytes, np.ndarray, int]], table: np.ndarray, bits: int = MAX_BITS) -> list[np.ndarray]:
    """Ids of several blocks (stream, marks, count); all lanes of all blocks advance together."""
    if not blocks:
        return []
    streams = [np.frombuffer(b, ">u4").astype(np.int64) for b, _, _ in blocks]
    base = np.cumsum([0, *(len(s) for s in streams[:-1])])
    data = np.concatenate(streams)
    lanes = [len(m) for _, m, _ in blocks]
    at = np.concatenate([np.asarray(m, np.int64) + 32 * b for (_, m, _), b in zip(blocks, base)])
    out = np.zeros((STRIDE, len(at)), np.int32)
    mask = (1 << bits) - 1
    top = 32 * len(data) - 64
    for k in range(STRIDE):
        np.minimum(at, top, out=at)
        slot = at >> 5
        window = (data[slot] << 32 | data[slot + 1]) >> (64 - bits - (at & 31)) & mask
        hit = table[window]
        out[k] = hit >> 8
        at += hit & 255
    edges = np.cumsum([0, *lanes])
    return [out[:, a:b].T.reshape(-1)[:n] for a, b, (_, _, n) in zip(edges, edges[1:], blocks)]


def windows_of(words: bytes, marks: np.ndarray, count: int, table: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of a long block, some at a time."""
    lanes = WINDOW // STRIDE
    for a in range(0, len(marks), lanes):
        own = marks[a : a + lanes]
        first = int(own[0]) // 32
        last = len(words) // 4 if a + lanes >= len(marks) else int(marks[a + lanes]) // 32 + 2
        yield unpack([(words[4 * first : 4 * last], own - 32 * first, min(WINDOW, count - a * STRIDE))], table)[0]


# --- ids of texts ---------------------------------------------------------------------------------


def text_ids(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids: every whole text's ids and the end id as little-endian 16-bit (vocabularies up to 65,536) or 32-bit integers."""
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        wide = np.dtype("<u2" if max(t.size, end_id + 1) <= 1 << 16 else "<u4")
        for batch in batches:
            for a, b in steps(batch.column(1)):
                own = batch.column(1).slice(a, b - a)
                if b - a == 1 and len(text_ := views(own)[0]) > 2 * STEP_BYTES:
                    # No rule looks across a space or a line break, so the ids of the parts are those of the whole.
                    ids = np.concatenate([t.flat(pa.array([str(w, "utf-8")]))[0].astype(wide) for w in windows(text_, STEP_BYTES, _CUTS)])
                    count = np.array([len(ids)])
                else:
                    ids, count = t.flat(own)
                ends = np.cumsum(count + 1)
                held = np.full(int(ends[-1]), end_id, wide)
                body = np.ones(len(held), bool)
                body[ends - 1] = False
                held[body] = ids
                offsets = np.r_[0, ends * wide.itemsize].astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(held)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), blobs], names=[key, "ids"])
        trim()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids binary")


def id_counts(ids: DataFrame, size: int, wide: str) -> np.ndarray:
    """Counts of all ids over the whole table; at most size rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                held = np.frombuffer(b"".join(batch.column(0).slice(first, 1000).to_pylist()), wide)
                for a in range(0, len(held), WINDOW):
                    total += np.bincount(held[a : a + WINDOW], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


# --- files ----------------------------------------------------------------------------------------

BLOCKS = "part int, block int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, words binary, marks array<long>"


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str | None = None, end_id: int = 2, partitions: int | None = None) -> None:
    """Encode all texts, in ascending doc_id order, into files of this format under path."""
    spark = docs.sparkSession
    file = tokenizer_file or tokenizer_path("word_bpe_49k.json")
    size = max(tokenizer(file).size, end_id + 1)
    wide = "<u2" if size <= 1 << 16 else "<u4"
    ids = cut(text_ids(docs, file, end_id).withColumn("doc_id", F.col("doc_id").cast("long")), "ids")
    counts = id_counts(ids, size, wide)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    need = int(counts.sum()) * np.dtype(wide).itemsize // RANGE_BYTES + 1
    n = partitions or max(need, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block = start = held = 0
        names: list = []
        pieces: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            words, marks = pack(np.concatenate(pieces), codes, lengths)
            values = [part, block, start, held, names, [len(x) for x in pieces], words, marks.tolist()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["part", "block", "start", "n_tokens", "doc_ids", "doc_tokens", "words", "marks"])

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                x = np.frombuffer(value.as_py(), wide)
                names.append(key.as_py())
                pieces.append(x)
                held += len(x)
                if held >= BLOCK_IDS:
                    yield row()
                    start += held
                    block, held, names, pieces = block + 1, 0, [], []
        if pieces:
            yield row()

    by = F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")
    ordered = ids.select("doc_id", "ids", F.xxhash64("ids").alias("_hash"), F.monotonically_increasing_id().alias("_row")).repartitionByRange(n, *by).sortWithinPartitions(*by)
    ordered.select("doc_id", "ids").mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    spark.createDataFrame(pa.table({"symbol": np.flatnonzero(lengths), "bits": lengths[lengths > 0]}), "symbol long, bits long").coalesce(1).write.parquet(f"{path}/code")
    release(ids)


def read_token_files(spark, path: str) -> DataFrame:
    """Documents from files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; see read_ids for the ids."""
    return _documents(spark, path, False)


def read_ids(spark, path: str) -> DataFrame:
    """As read_token_files, with ids (array of int)."""
    return _documents(spark, path, True)


def _documents(spark, path: str, keep: bool) -> DataFrame:
    code = spark.read.schema("symbol long, bits long").parquet(f"{path}/code").toArrow()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    lengths = np.zeros(int(max(code["symbol"].to_pylist(), default=0)) + 1, np.int64)
    lengths[code["symbol"].to_numpy()] = code["bits"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)

        def long(r: dict, out: list[list]) -> None:
            """The documents of a block that is decoded in windows."""
            held, left = np.zeros(0, np.int32), windows_of(r["words"], np.array(r["marks"]), r["n_tokens"], table)
            done = 0
            for key, n in zip(r["doc_ids"], r["doc_tokens"]):
                crc, need, kept = 0, n, []
                while need:
                    if not len(held):
                        held = next(left)
                    part, held = held[:need], held[need:]
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    need -= len(part)
                    if keep:
                        kept.append(part)
                for column, value in zip(out, (r["part"], key, r["start"] + done, n, crc)):
                    column.append(value)
                if keep:
                    out[5].append(np.concatenate(kept))
                done += n

        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                rows = batch.slice(at, 8).to_pylist()
                out: list[list] = [[], [], [], [], [], []]
                for r in [r for r in rows if r["n_tokens"] > WINDOW]:
                    rows.remove(r)
                    long(r, out)
                for r, ids in zip(rows, unpack([(r["words"], np.array(r["marks"]), r["n_tokens"]) for r in rows], table)):
                    raw, done = memoryview(ids.astype("<u4").tobytes()), 0
                    for key, n in zip(r["doc_ids"], r["doc_tokens"]):
                        for column, value in zip(out, (r["part"], key, r["start"] + done, n, zlib.crc32(raw[4 * done : 4 * (done + n)]))):
                            column.append(value)
                        if keep:
                            out[5].append(ids[done : done + n])
                        done += n
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + keep]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 + keep])

    docs = blocks.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep else ""))
    # One row per part: a few per GB, so one task can add them up.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    out = docs.join(parts, "part").withColumn("start", F.col("start") + F.col("before"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep else []))


def token_file_digests(docs: DataFrame) -> DataFrame:
    """Write all documents to files in the shared folder and describe them from what the files hold."""
    path = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    forget(docs.sparkSession, path)
    write_token_files(docs, path)
    return read_token_files(docs.sparkSession, path)

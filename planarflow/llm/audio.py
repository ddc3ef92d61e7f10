"""Media columns: a payload stored as 8-bit PCM audio, and features of what was stored.

Each row's bytes become the samples of a mono WAV file, are read back from it, and are described by: polyphase resampling
to the feature rate (any ratio UP / DOWN), overlapped log-mel filterbanks, and energy segmentation with hysteresis. Features
are fixed-shape tensors (FRAMES x MELS float32 for each row, the clip's frames pooled into FRAMES equal time spans) beside the
time spans in seconds that the segmentation found. Spark has no tensor type: the column holds the numbers in order and its
metadata the shape, and as_tensors() gives Arrow tables in which it is a fixed-shape tensor. Values depend on the bytes alone,
so equal texts have equal values.

Null texts count as empty and are padded like any other; long texts are handled in windows, so that besides the text, its
payload and the stored form (which a cell's size bounds) a row takes 4 bytes for each frame. Repeated rows give equal rows, an empty table gives an empty table, further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trim, views

#: Payloads are padded with PAD to a positive multiple of UNIT bytes.
UNIT, PAD = 192, b" "
RATE, UP, DOWN = 16_000, 1, 2
WINDOW, HOP, FFT, MELS, FRAMES = 200, 100, 256, 32, 8
#: Frames whose level exceeds the clip's mean by OPEN decibels start a segment; it ends where the level falls below SHUT.
OPEN, SHUT = 1.0, -1.0
_TAPS = 32
#: Frames that are handled at once.
STEP = 4096
_SHAPE = {"ARROW:extension:name": "arrow.fixed_shape_tensor", "ARROW:extension:metadata": json.dumps({"shape": [FRAMES, MELS]})}


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Mono, unsigned 8-bit PCM."""
    odd = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def from_wav(media: bytes | memoryview) -> bytes | memoryview:
    """The samples of a file that to_wav wrote; others are rejected. Of a view, a view."""
    riff, _, wave, fmt, size, kind, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, fmt, size, kind, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data") or len(media) < 44 + n:
        raise ValueError("not a mono 8-bit PCM file")
    return media[44 : 44 + n]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Window and mel filters."""
    rate = RATE * UP / DOWN
    hertz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edge = hertz(np.linspace(0, top, MELS + 2))
    f = np.arange(FFT // 2 + 1) * rate / FFT
    up = (f[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2])
    down = (edge[2:] - f[:, None]) / (edge[2:] - edge[1:-1])
    return np.hanning(WINDOW).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


@lru_cache(maxsize=8)
def _phases(up: int, down: int) -> tuple[np.ndarray, list[list[tuple[int, int, np.ndarray]]]]:
    """Low-pass taps on the grid of up, and for each phase of the output the taps that meet each phase of the input.

    A phase's taps come as (residue, first, taps): output j of it sums taps[t] * x[(j + first + t) * down + residue]."""
    wide = max(up, down)
    half = _TAPS * wide // 2
    t = np.arange(2 * half + 1) - half
    taps = np.sinc(t / wide) * np.hamming(len(t))
    taps *= up / taps.sum()
    out = []
    for r in range(up):
        least, most = -((half - r * down) // up), (r * down + half) // up
        own = {i: taps[r * down + half - i * up] for i in range(least, most + 1) if 0 <= r * down + half - i * up < len(taps)}
        out.append([])
        for q in range(down):
            at = sorted(i for i in own if i % down == q)
            if at:
                out[-1].append((q, at[0] // down, np.array([own[i] for i in at], np.float32)))
    return taps.astype(np.float32), out


def resampled(n: int, up: int = UP, down: int = DOWN) -> int:
    """How many samples n samples become."""
    return -(-n * up // down)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, first: int = 0, last: int | None = None) -> np.ndarray:
    """Samples first to last of x at up / down of its rate: each phase of the output runs its own taps over the input's phases."""
    last = resampled(len(x), up, down) if last is None else last
    out = np.zeros(last - first, np.float32)
    margin = _TAPS * max(up, down) // 2 // up + 2
    for r, phases in enumerate(_phases(up, down)[1]):
        j = range(-((r - first) // up) if r < first else 0, (last - 1 - r) // up + 1 if last > r else 0)  # outputs r + j * up
        if not len(j):
            continue
        # The input that these outputs meet, in steps of down, with zeros beyond its ends.
        a, b = j[0] * down - (margin // down + 1) * down, (j[-1] + margin // down + 2) * down
        own = np.zeros(b - a, np.float32)
        held = x[max(0, a) : max(0, min(len(x), b))]
        own[max(0, -a) : max(0, -a) + len(held)] = held
        for q, start, taps in phases:
            line = own[q::down][j[0] + start - a // down :][: len(j) + len(taps) - 1]
            out[r + j[0] * up - first : r + j[-1] * up - first + 1 : up] += np.convolve(line, taps[::-1], "valid")[: len(j)]
    return out


def log_mel(x: np.ndarray, count: int | None = None) -> np.ndarray:
    """Frames x MELS log energies, the last frame padded with zeros."""
    window, filters = _tables()
    count = frames_of(len(x)) if count is None else count
    x = np.pad(x, (0, max(0, WINDOW + (count - 1) * HOP - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP][:count]
    spectrum = np.fft.rfft(frames * window, FFT)
    power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
    return np.log10(power @ filters + np.float32(1e-6))


def frames_of(n: int) -> int:
    return max(1, 1 - (WINDOW - n) // HOP)


def segments(level: np.ndarray) -> np.ndarray:
    """First and last frame (exclusive) of each stretch that opens above OPEN and stays until below SHUT."""
    rel = level - level.mean()
    state = np.where(rel >= OPEN, 1, np.where(rel < SHUT, -1, 0))
    at = np.flatnonzero(state)
    on = np.zeros(len(rel) + 1, bool)
    if len(at):
        last = np.maximum.accumulate(np.where(state != 0, np.arange(len(rel)), -1))
        on[:-1] = (last >= 0) & (state[np.maximum(last, 0)] > 0)
    edges = np.diff(np.r_[False, on].astype(np.int8))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


def features(samples: bytes | memoryview, up: int = UP, down: int = DOWN) -> tuple[np.ndarray, np.ndarray]:
    """FRAMES x MELS tensor and time spans (seconds) of 8-bit samples, STEP frames at a time."""
    raw = np.frombuffer(samples, np.uint8)
    size = resampled(len(raw), up, down)
    count = frames_of(size)
    edges = np.linspace(0, count, FRAMES + 1)
    first = np.minimum(edges[:-1].astype(int), count - 1)
    last = np.maximum(np.ceil(edges[1:]).astype(int), first + 1)
    pooled, level = np.zeros((FRAMES, MELS)), np.empty(count, np.float32)
    for a in range(0, count, STEP):
        b = min(count, a + STEP)
        start, end = a * HOP, min(size, (b - 1) * HOP + WINDOW)
        # A multiple of down whose reach covers the window's taps.
        low = max(0, (start * down // up - 4 * _TAPS * max(up, down)) // down * down)
        part = raw[low : end * down // up + 4 * _TAPS * max(up, down)].astype(np.float32) / 128 - 1
        shift = low // down * up
        mel = log_mel(resample(part, up, down, start - shift, end - shift), b - a)
        level[a:b] = mel.mean(axis=1)
        for k in range(FRAMES):
            if first[k] < b and last[k] > a:
                pooled[k] += mel[max(first[k], a) - a : min(last[k], b) - a].sum(axis=0, dtype=np.float64)
    spans = segments(10 * level)
    return (pooled / (last - first)[:, None]).astype(np.float32), np.minimum(spans * HOP + np.array([0, WINDOW - HOP]), size) / (RATE * up / down)


def tensor_column(rows: list[np.ndarray]) -> pa.Array:
    """Rows of one shape as an Arrow fixed-shape tensor array."""
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    flat = np.concatenate([r.ravel() for r in rows]) if rows else np.zeros(0, np.float32)
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), FRAMES * MELS))


def describe(tensor: np.ndarray, spans: np.ndarray) -> str:
    """Short text of a row's features: shape, digest of the tensor rounded to 1/100, mean level, number and length of spans."""
    rounded = np.round(tensor * 100).astype("<i4").tobytes()
    total = float((spans[:, 1] - spans[:, 0]).sum()) if len(spans) else 0.0
    return f"mel{FRAMES}x{MELS}:{hashlib.sha256(rounded).hexdigest()[:16]}:mean={tensor.mean():.3f}:spans={len(spans)}:{total:.3f}s"


def as_tensors(table: pa.Table) -> pa.Table:
    """An Arrow table of media columns (as toArrow() or Spark's Parquet files give it) with the tensor as fixed-shape tensors."""
    at = table.column_names.index("tensor")
    flat = [c.flatten().to_numpy(zero_copy_only=False).reshape(-1, FRAMES, MELS) for c in table["tensor"].chunks]
    held = pa.chunked_array([tensor_column(list(c)) for c in flat], pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS)))
    return table.set_column(at, "tensor", held)


_SPAN = pa.struct([("start", pa.float64()), ("end", pa.float64())])


def media_columns(docs: DataFrame, keep_media: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as audio, read it back and describe it; a narrow pass without a shuffle.

    Returns digests, the feature string, the tensor (FRAMES x MELS numbers, the shape in the column's metadata) and the time
    spans (start, end); with keep_media also the stored bytes."""
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)
    plain = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    spell = {pa.int64(): "long", pa.string(): "string"}
    schema = ", ".join([f"`{key}` {kind}", *(f"{k} {spell[v]}" for k, v in plain.items()), "tensor array<float>, spans array<struct<start:double,end:double>>", *(["media binary"] if keep_media else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tensors, spans, kept = [], [], [], []
            for data in views(batch.column(1)):
                payload = bytes(data) + PAD * (-len(data) % UNIT if data else UNIT)
                media = to_wav(payload)
                back = from_wav(memoryview(media))
                tensor, span = features(back)
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(tensor, span)))
                tensors.append(tensor)
                spans.append(span)
                if keep_media:
                    kept.append(media)
            columns = [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(plain.values()))]
            # The tensors' numbers and their ends: what lies in the tensor array is the list array's content as it is.
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (FRAMES * MELS))
            columns.append(pa.ListArray.from_arrays(ends, tensor_column(tensors).storage.flatten()))
            flat = np.concatenate(spans) if spans else np.zeros((0, 2))
            both = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.float64()), pa.array(flat[:, 1], pa.float64())], fields=list(_SPAN))
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for x in spans)]), pa.int32()), both))
            names = [key, *plain, "tensor", "spans"]
            if keep_media:
                columns.append(pa.array(kept, pa.binary()))
                names.append("media")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        trim()

    out = docs.select(key, text).mapInArrow(run, schema)
    return out.withColumn("tensor", F.col("tensor").alias("tensor", metadata=_SHAPE))

"""Varints and shard records as column expressions: null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planarflow.sources.codec import FLAG_MAGIC, HASH_CHARS, RAW_MAGIC


def _byte(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def varint(value: Column) -> Column:
    """A whole number, not negative, as little-endian base 128; a negative one raises."""
    value = F.when(value < 0, F.raise_error(F.lit("varints are not negative"))).otherwise(value).cast("long")
    last = F.ceil(F.length(F.bin(value)) / 7).cast("int") - 1
    group = lambda i: F.call_function("shiftright", value, i * 7).bitwiseAND(F.lit(127))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: _byte(F.when(i < last, group(i) + 128).otherwise(group(i)))), ""))


def unvarint(data: Column) -> Column:
    """The number that a varint of at most nine bytes stands for."""
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.octet_length(data) - 1), F.lit(0).cast("long"), lambda sum_, i: sum_ + F.call_function("shiftleft", byte(i).bitwiseAND(F.lit(127)), i * 7))


def _text(data: Column) -> Column:
    return F.decode(data, "utf-8")


def _rest(data: Column, at: Column | int) -> Column:
    """The bytes from at (from 1) on."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.substring(data, at, F.octet_length(data))


def _bytes(value: Column) -> Column:
    return F.encode(value, "utf-8")


def reduced(report_hash: Column, work_hash: Column, payload: Column) -> Column:
    return F.concat(_bytes(report_hash), _bytes(work_hash), payload)


def reduced_parts(data: Column) -> Column:
    """report_hash, work_hash and payload of a reduced record; one that is too short raises."""
    data = F.when(F.octet_length(data) < 2 * HASH_CHARS, F.raise_error(F.lit("reduced record is too short"))).otherwise(data).cast("binary")
    part = lambda k: _text(F.substring(data, F.lit(1 + k * HASH_CHARS), F.lit(HASH_CHARS)))
    return F.struct(part(0).alias("report_hash"), part(1).alias("work_hash"), _rest(data, 1 + 2 * HASH_CHARS).alias("payload"))


def raw(bucket_hash: Column, payload: Column) -> Column:
    return F.concat(F.lit(bytearray(RAW_MAGIC)), _bytes(bucket_hash), payload)


def _begins(data: Column, magic: bytes) -> Column:
    return F.substring(data, F.lit(1), F.lit(len(magic))) == F.lit(bytearray(magic))


def raw_parts(data: Column, fallback: Column) -> Column:
    """bucket_hash and payload of a raw record; one without its header lies in the fallback's bucket."""
    own = _begins(data, RAW_MAGIC)
    head = len(RAW_MAGIC)
    return F.struct(F.when(own, _text(F.substring(data, F.lit(1 + head), F.lit(HASH_CHARS)))).otherwise(F.when(data.isNotNull(), fallback)).alias("bucket_hash"), F.when(own, _rest(data, 1 + head + HASH_CHARS)).otherwise(data).alias("payload"))


def flagged(flag_hash: Column, invariant: Column, flag: Column) -> Column:
    key = _bytes(invariant)
    return F.concat(F.lit(bytearray(FLAG_MAGIC)), _bytes(flag_hash), F.unhex(F.lpad(F.hex(F.octet_length(key)), 8, "0")), key, _bytes(flag))


def flagged_parts(data: Column) -> Column:
    """flag_hash, invariant and flag of a flag record; a bare flag has neither."""
    own, head = _begins(data, FLAG_MAGIC), len(FLAG_MAGIC) + HASH_CHARS
    size = F.conv(F.hex(F.substring(data, F.lit(1 + head), F.lit(4))), 16, 10).cast("int")
    known = lambda c, bare: F.when(own, c).otherwise(F.when(data.isNotNull(), bare))
    return F.struct(
        known(_text(F.substring(data, F.lit(1 + len(FLAG_MAGIC)), F.lit(HASH_CHARS))), F.lit("")).alias("flag_hash"),
        known(_text(F.substring(data, F.lit(5 + head), size)), F.lit("")).alias("invariant"),
        known(_text(_rest(data, F.lit(5 + head) + size)), _text(data)).alias("flag"),
    )

"""Sharding by a k-d tree: nodes are split at distributed weighted medians along their widest dimension.

Every row has coordinates, by default metadata that follow from its text (bytes, bytes per character, lines, characters per word),
so that equal texts lie at one point and stay in one shard. A coordinate counts by its place between the KNOTS quantiles of all
rows, so that outliers do not make a dimension wide; a checksum of the text orders rows of equal coordinates. A node that still
holds several shards' bytes is cut along the dimension in which its rows spread widest, at the weight quantile that gives either side its number of shards' bytes. The quantile is
found by radix descent: counts of bytes by the next BITS bits of the sort key, for all nodes of a level at once, until the
bucket that holds it weighs less than SLACK of a shard. If a single text's copies straddle the cut, it moves to their edge
when that costs at most GROUP_SLACK of a shard, and else divides them by a hash of the doc_id: a hot group does not unbalance
the shards. At most shards x 2^BITS sums reach the driver at once, whatever the input.

Nulls: a null text has no bytes and the checksum of an empty one; a null doc_id is hashed as such. Rows that are equal in
doc_id and text stay together. A document larger than a shard makes its shard too large by no more than itself. An empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

SHARDS, BITS, SLACK, GROUP_SLACK = 24, 13, 0.001, 0.01
#: Bits of a coordinate, of the checksum behind it, and of the hash that divides copies.
_AXIS, _SUM, _COPY = 26, 32, 31
_ROW_BYTES, _SLOT_ROWS, KNOTS = 8, 50_000, 32


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + _ROW_BYTES).cast("long")


def text_dimensions(text: Column) -> dict[str, Column]:
    """The default coordinates of a text."""
    t = F.coalesce(text, F.lit(""))
    size, chars = F.octet_length(t).cast("double"), F.length(t).cast("double")
    count = lambda c: (F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit("")))).cast("double")
    lines = count("\n")
    return {"size": F.log2(size + 1), "width": size / F.greatest(chars, F.lit(1.0)), "lines": F.log2(lines + 1), "words": chars / (count(" ") + lines + 1)}


def between(value: Column, knots: list[float]) -> Column:
    """Where a value lies between ascending knots, 0 to 1; order is kept."""
    knots = sorted(set(knots))
    if len(knots) < 2:
        return F.lit(0.0)
    held = F.lit(knots)
    at = F.least(F.greatest(F.size(F.filter(held, lambda k: k <= value)), F.lit(1)), F.lit(len(knots) - 1))
    low, high = F.element_at(held, at), F.element_at(held, at + 1)
    return (at - 1 + F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))) / (len(knots) - 1)


@dataclass
class Node:
    """Shards first to last (exclusive), the axis of its cut, and the search for it: the weight to reach, the weight before
    the bucket that holds it, the bucket's leading bits, and in the end the cut (key, copy)."""

    first: int
    last: int
    axis: int = 0
    goal: float = 0.0
    before: float = 0.0
    known: int = 0
    bits: int = 0
    step: int = 0
    at: tuple[int, int] | None = None

    @property
    def middle(self) -> int:
        return (self.first + self.last) // 2


_KEY = _AXIS + _SUM


def _lookup(nodes: list[Node], value, other=0) -> Column:
    """value(node) for each row's node; rows of other nodes get `other`."""
    held = {n.first: value(n) for n in nodes}
    return F.element_at(F.lit([held.get(i, other) for i in range(max(held) + 1)]), F.col("node") + 1)


def _right(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by.cast("int"))


def _radix(rows: DataFrame, nodes: list[Node], leaf: float) -> None:
    """Advance the searches of nodes by one digit; rows have node, key (axis and checksum), copy and size."""
    for n in nodes:
        n.step = min(BITS, (_KEY if n.bits < _KEY else _KEY + _COPY) - n.bits)
    tail = lambda n: _KEY + _COPY - n.bits if n.bits >= _KEY else 0
    in_key = _lookup(nodes, lambda n: n.bits < _KEY, False)
    inside_key = _right(F.col("key"), _lookup(nodes, lambda n: max(0, _KEY - n.bits))) == _lookup(nodes, lambda n: n.known if n.bits < _KEY else n.known >> (n.bits - _KEY))
    inside_copy = _right(F.col("copy"), _lookup(nodes, lambda n: tail(n))) == _lookup(nodes, lambda n: n.known & ((1 << (n.bits - _KEY)) - 1) if n.bits >= _KEY else 0)
    digit_key = _right(F.col("key"), _lookup(nodes, lambda n: max(0, _KEY - n.bits - n.step)))
    digit_copy = _right(F.col("copy"), _lookup(nodes, lambda n: max(0, tail(n) - n.step)))
    mask = _lookup(nodes, lambda n: (1 << n.step) - 1)
    digit = F.when(in_key, digit_key).otherwise(digit_copy).bitwiseAND(mask.cast("long"))
    found = rows.where(F.col("node").isin([n.first for n in nodes])).where(inside_key & (in_key | inside_copy))
    sums: dict[int, list[tuple[int, int]]] = {}
    for r in found.select("node", digit.cast("int").alias("digit"), "size").groupBy("node", "digit").agg(F.sum("size").alias("size")).collect():
        sums.setdefault(r["node"], []).append((r["digit"], r["size"]))
    for n in nodes:
        upto = n.before
        for d, size in sorted(sums.get(n.first, [])):
            if upto + size >= n.goal:
                break
            upto += size
        else:
            n.at = (1 << 62, 0)
            continue
        bits, known = n.bits + n.step, n.known << n.step | d
        below, above = n.goal - upto, upto + size - n.goal
        edge_of_text = bits == _KEY and min(below, above) <= GROUP_SLACK * leaf
        if size <= SLACK * leaf or edge_of_text or bits == _KEY + _COPY:
            end = known if below <= above else known + 1
            extra = bits - _KEY
            n.at = (end << -extra, 0) if extra <= 0 else (end >> extra, (end & ((1 << extra) - 1)) << (_COPY - extra))
        else:
            n.bits, n.known, n.before = bits, known, upto


def kd_tree(points: DataFrame, shards: int, axes: int) -> DataFrame:
    """Split rows (k0, k1, ... sort keys by axis, copy, size) into shards of nearly equal size: rows with node, their shard."""
    nodes = [Node(0, shards)]
    rows = points.withColumn("node", F.lit(0))
    while any(n.last - n.first > 1 for n in nodes):
        span = [F.max(f"k{a}") - F.min(f"k{a}") for a in range(axes)]
        stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("held"), *(s.alias(f"w{a}") for a, s in enumerate(span))).collect()}
        leaf = sum(r["held"] for r in stats.values()) / shards
        open_ = [n for n in nodes if n.last - n.first > 1]
        for n in open_:
            if r := stats.get(n.first):
                n.axis = max(range(axes), key=lambda a: (r[f"w{a}"], -a))
                n.goal = r["held"] * (n.middle - n.first) / (n.last - n.first)
        key = F.element_at(F.array(*(f"k{a}" for a in range(axes))), _lookup(open_, lambda n: n.axis) + 1)
        keyed = rows.withColumn("key", key)
        while searches := [n for n in open_ if n.at is None]:
            _radix(keyed, searches, leaf)
        cut_key, cut_copy = _lookup(open_, lambda n: n.at[0], 1 << 62), _lookup(open_, lambda n: n.at[1])
        left = (F.col("key") < cut_key.cast("long")) | ((F.col("key") == cut_key.cast("long")) & (F.col("copy") < cut_copy))
        node = F.when(F.col("node").isin([n.first for n in open_]) & ~left, _lookup(open_, lambda n: n.middle)).otherwise(F.col("node"))
        new = cut(keyed.withColumn("node", node).drop("key"), "points")
        release(rows)
        rows = new
        nodes = [x for n in nodes for x in ([Node(n.first, n.middle), Node(n.middle, n.last)] if n.last - n.first > 1 else [n])]
    return rows


def shard_documents(docs: DataFrame, shards: int = SHARDS, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null: shards are not stable in number)."""
    text = F.col("text")
    dims = list((dimensions or text_dimensions(text)).values())
    checksum = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    copy = F.shiftrightunsigned(F.xxhash64("doc_id", checksum), 64 - _COPY)
    raw = cut(docs.select("doc_id", row_size(text).alias("size"), checksum.alias("text_crc32"), copy.alias("copy"), *(F.coalesce(F.nanvl(d.cast("double"), F.lit(None)), F.lit(0.0)).alias(f"d{a}") for a, d in enumerate(dims))), "points")
    knots = lambda c: F.concat(F.array(F.min(c)), F.percentile_approx(c, [k / KNOTS for k in range(1, KNOTS)], 1000), F.array(F.max(c)))
    ends = raw.agg(F.count("*").alias("n"), *(knots(f"d{a}").alias(f"k{a}") for a in range(len(dims)))).first()
    scale = lambda a: between(F.col(f"d{a}"), [k for k in ends[f"k{a}"] or () if k is not None])
    axis = lambda a: F.shiftleft((scale(a) * ((1 << _AXIS) - 1)).cast("long"), _SUM) + F.col("text_crc32")
    points = raw.select("doc_id", "size", "text_crc32", "copy", *(axis(a).alias(f"k{a}") for a in range(len(dims))))
    points = cut(points, "points")
    release(raw)
    placed = kd_tree(points, shards, len(dims)).select("doc_id", "size", "text_crc32", "copy", F.col("node").alias("shard"))
    # Slots are numbered within buckets of a shard, so that no task sorts a whole shard.
    bits = max(3, (ends["n"] // (shards * _SLOT_ROWS)).bit_length())
    placed = placed.withColumn("bucket", F.shiftright("copy", _COPY - bits).cast("int"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("copy", "doc_id", "text_crc32")) - 1
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "bucket", before.alias("before"))
    out = placed.withColumn("within", within).join(counts, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

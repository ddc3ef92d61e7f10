"""Similarity join on word shingles by vertical partitioning.

The global order of shingles is cut into fragments; a document's set is cut into segments along with it. What can be counted
fragment by fragment is counted there and summed per document or per pair:

1. Support. Of a document with a partner, at least `percent` % of the shingles occur in another document as well. Each
   fragment counts for each document how many of its shingles do; the sums leave few documents, with these shingles only.
   Shingles that a sample shows in several rows are known to be shared and are counted where they stand, so one that a third of
   all documents hold gathers nowhere; what the sample misses is counted as any other, so results do not depend on it.
2. Copies. Documents with equal sets become one representative; membership is joined back at the end.
3. Order. Among the representatives support is counted again, and shingles are ordered by their number of documents, then by
   hash. The prefix filter and the positional filter hold in this order: a pair's first common shingle must lie early in both.
4. Links. First every document is compared with a leader under each of its prefix shingles. Then those that share a prefix
   shingle but are not connected so far are compared. A pair's overlap is counted by fragments of the order and
   summed. Pairs that are connected already need no comparison: classes do not change by it.

There are as many fragments as the text needs; beyond FLAT bits they are dealt in two steps, so that packed rows stay long.
similar_pairs() verifies every pair that may link, connected or not, and gives the join itself: pairs of representatives and membership.

Shingles are 64-bit hashes of the words' bytes, of which 56 or more bits are compared, so a pair's overlap is wrong by one
with a chance of about |A||B| / 2^56. Rows that hold shingles are packed: one per slice of input and fragment.

Nulls: null or empty texts, or ones of white space only, have an empty set, are linked with nothing and keep their own class.
A null doc_id takes part; a class whose doc_ids are all null has a null component_id. Repeated rows are rows of their own with
equal sets. Very long texts are read in windows; a task holds two words of 8 bytes for each word of the longest. An empty table
gives an empty table; further columns, also of clashing names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import cut, mix64, scratch, shingle_hashes, slices, small_batches, trim, views
from .components import components

WIDTH, PERCENT = 5, 75
#: Bytes of text per fragment, and documents that share a shingle beyond which its pairs are dealt to several tasks.
FRAGMENT_BYTES, HEAVY = 1 << 24, 512
#: Rows that are sampled, of at most a share of all, for shingles that many documents share, sampled rows that must hold one, and shingles kept at most (8 bytes each).
SAMPLE, SHARE, SAMPLED, COMMON = 10_000, 0.05, 3, 1 << 20
#: Leading bits of a shingle by which fragments are dealt in one step.
FLAT = 16
#: Shingles that a task gathers before it deals them to fragments; with many fragments more, so that rows stay long.
SCATTER = 1 << 18
_PACK = "part int, kind int, uids binary, sizes binary, tokens binary, more binary"
_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("uids", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), ("more", pa.binary())])


def _row(part: int, kind: int, uids: np.ndarray, sizes: np.ndarray, tokens: bytes = b"", more: bytes = b"") -> tuple:
    return part, kind, uids.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), tokens, more


def _batch(rows: list[tuple], schema: pa.Schema = _ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _narrow(tokens: np.ndarray, bits: int) -> bytes:
    """Hashes of one fragment, without the fragment's bits, in 7 bytes each."""
    return ((tokens << np.uint64(bits)) >> np.uint64(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1]
    return start, np.diff(np.r_[start, len(values)])


def _scatter(uid: np.ndarray, tokens: np.ndarray, bits: int) -> Iterator[tuple]:
    """Packed rows of (document, shingle) pairs, sorted by document, for each fragment."""
    part = (tokens >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64) if bits else np.zeros(len(tokens), np.uint16)
    order = np.argsort(part, kind="stable")
    uid, tokens, part = uid[order], tokens[order], part[order]
    for a, n in zip(*_runs(part)):
        own = uid[a : a + n]
        start, size = _runs(own)
        yield _row(int(part[a]), 0, own[start], size, _narrow(tokens[a : a + n], bits))


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uids, sizes and shingles of a fragment's packed rows."""
    join = lambda c: b"".join(table[c].to_pylist())
    return np.frombuffer(join("uids"), "<i8"), np.frombuffer(join("sizes"), "<i4"), _wide(join("tokens"))


def _bucket(uid: np.ndarray, count: int) -> np.ndarray:
    return (mix64(uid.astype(np.uint64)) % np.uint64(count)).astype(np.int64)


def _dealt(uid: np.ndarray, tokens: np.ndarray, df: np.ndarray, buckets: int, kind: int) -> Iterator[tuple]:
    """Packed rows of (document, shingle, number of documents) for each bucket of documents."""
    bucket = _bucket(uid, buckets)
    order = np.argsort(bucket, kind="stable")
    uid, tokens, df, bucket = uid[order], tokens[order], df[order].astype(np.int32), bucket[order]
    for a, n in zip(*_runs(bucket)):
        start, count = _runs(uid[a : a + n])
        yield _row(int(bucket[a]), kind, uid[a : a + n][start], count, tokens[a : a + n].tobytes(), df[a : a + n].tobytes())


class Common:
    """Shingles that are known to be in several documents, each with an estimate of their number that orders them."""

    def __init__(self, tokens: np.ndarray, df: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.df = tokens[order], df[order]
        self.may = np.zeros(1 << 20, bool)
        self.may[(tokens >> np.uint64(44)).astype(np.int64)] = True

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the tokens are known, and the number of documents of those."""
        known = self.may[(tokens >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(known)
        at = np.searchsorted(self.tokens, tokens[maybe])
        hit = self.tokens[np.minimum(at, len(self.tokens) - 1)] == tokens[maybe] if len(self.tokens) else np.zeros(0, bool)
        known[maybe] = hit
        return known, self.df[at[hit]]


def common_shingles(docs: DataFrame, width: int = WIDTH) -> Common:
    """Shingles of several rows of a sample; at most COMMON reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = views(batch.column(0))
            for a, b in slices(texts):
                tokens = shingle_hashes(texts[a:b], width)[1]
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["token"])

    count = docs.count()
    part = min(SHARE, SAMPLE / max(1, count))
    found = docs.select("text").sample(part, 7).mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n"))
    found = found.where(F.col("n") >= SAMPLED).orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    df = np.minimum(found["n"].to_numpy() / part, 1 << 30).astype(np.int32)
    return Common(found["token"].to_numpy().view(np.uint64), df)


def _shared(bits: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """For a fragment: each document's shingles that another one has too, with their number of documents, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        part = table["part"][0].as_py()
        out: list[tuple] = []
        for r in table.filter(pa.array(kinds == 1)).to_pylist():
            uid = np.frombuffer(r["uids"], "<i8")
            more = np.frombuffer(r["more"], np.uint8).reshape(len(uid), -1)
            bucket = _bucket(uid, buckets)
            for b in np.unique(bucket):
                at = bucket == b
                out.append(_row(int(b), 1, uid[at], np.frombuffer(r["sizes"], "<i4")[at], more=more[at].tobytes()))
        for r in table.filter(pa.array(kinds == 2)).to_pylist():  # counted where they stood, and dealt by document
            out.append((part, 0, r["uids"], r["sizes"], r["tokens"], r["more"]))
        uid, size, tokens = _gathered(table.filter(pa.array(kinds == 0)))
        if len(tokens):
            owner = np.repeat(np.arange(len(uid)), size)
            order = np.argsort(tokens)
            start, n = _runs(tokens[order])
            df = np.empty(len(tokens), np.int32)
            df[order] = np.repeat(n, n)
            keep = df >= 2
            owner, tokens, df = owner[keep], tokens[keep], df[keep]
            full = (tokens << np.uint64(8)) >> np.uint64(bits) | (np.uint64(part) << np.uint64(64 - bits) if bits else np.uint64(0))
            out += _dealt(uid[owner], full, df, buckets, 0)
        del uid, size, tokens
        trim()
        return pa.Table.from_batches([_batch(out)], _ARROW)

    return run


def _support(percent: int, fields: int, ordered: bool) -> Callable[[pa.Table], pa.Table]:
    """For a bucket of documents: sum the fragments' counts, keep the shingles of those that may have a partner."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        join = lambda t, c: b"".join(t[c].to_pylist())
        info, held = table.filter(pa.array(kinds == 1)), table.filter(pa.array(kinds == 0))
        uid, n = np.frombuffer(join(info, "uids"), "<i8"), np.frombuffer(join(info, "sizes"), "<i4").astype(np.int64)
        more = np.frombuffer(join(info, "more"), "<i8").reshape(len(uid), fields)
        order = np.argsort(uid)
        uid, n, more = uid[order], n[order], more[order]
        at = np.searchsorted(uid, np.repeat(np.frombuffer(join(held, "uids"), "<i8"), np.frombuffer(join(held, "sizes"), "<i4")))
        tokens, df = np.frombuffer(join(held, "tokens"), "<u8"), np.frombuffer(join(held, "more"), "<i4")
        shared = np.bincount(at, minlength=len(uid))
        alive = (100 * shared >= percent * n) & (n > 0)
        keep = alive[at]
        at, tokens, df = at[keep], tokens[keep], df[keep]
        order = np.lexsort((tokens, df, at)) if ordered else np.lexsort((tokens, at))
        ends = np.cumsum(np.bincount(at, minlength=len(uid)))
        tokens, df = tokens[order], df[order]
        cells = [(tokens[e - c : e].tobytes(), df[e - c : e].tobytes()) if ok else (None, None) for e, c, ok in zip(ends, np.where(alive, shared, 0), alive)]
        columns = {"uid": pa.array(uid, pa.int64()), "n": pa.array(n, pa.int64()), "shared": pa.array(shared, pa.int64())}
        columns |= {f"m{i}": pa.array(more[:, i], pa.int64()) for i in range(fields)}
        columns |= {"tokens": pa.array([c[0] for c in cells], pa.binary()), "df": pa.array([c[1] for c in cells] if ordered else [None] * len(uid), pa.binary())}
        del tokens, df, at, order
        trim()
        return pa.table(columns)

    return run


def _refined(packed: DataFrame, bits: int, flat: int) -> DataFrame:
    """Rows packed by the first flat bits of their shingles, packed by bits of them."""
    if bits <= flat:
        return packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            fine = np.asarray(batch.column(1).to_numpy()) != 0
            yield batch.filter(pa.array(fine))
            for r in batch.filter(pa.array(~fine)).to_pylist():
                lead = np.uint64(r["part"]) << np.uint64(64 - flat) if flat else np.uint64(0)
                tokens = (_wide(r["tokens"]) << np.uint64(8)) >> np.uint64(flat) | lead
                held.append((np.repeat(np.frombuffer(r["uids"], "<i8"), np.frombuffer(r["sizes"], "<i4")), tokens))
            if sum(len(t) for _, t in held) >= max(SCATTER, 32 << (bits - flat)):
                yield _batch(list(_scatter(*map(np.concatenate, zip(*held)), bits)))
                held.clear()
        if held:
            yield _batch(list(_scatter(*map(np.concatenate, zip(*held)), bits)))

    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(run, _PACK)


def _supported(packed: DataFrame, bits: int, percent: int, fields: int, ordered: bool, flat: int = FLAT) -> DataFrame:
    names = "uid long, n long, shared long, " + "".join(f"m{i} long, " for i in range(fields)) + "tokens binary, df binary"
    shared = _refined(packed, bits, flat).groupBy("part").applyInArrow(_shared(bits, 1 << bits), _PACK)
    return shared.groupBy("part").applyInArrow(_support(percent, fields, ordered), names)


class _Scatter:
    """Gathers (document, shingle) pairs and packs them: known shingles by document, others by fragment."""

    def __init__(self, bits: int, flat: int, common: Common):
        self.bits, self.flat, self.common, self.rare, self.known = bits, min(bits, flat), common, [], []

    def add(self, uid: np.ndarray, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        known, df = self.common.find(tokens)
        if len(df):
            self.known.append((uid[known], tokens[known], df))
            uid, tokens = uid[~known], tokens[~known]
        self.rare.append((uid, tokens))
        yield from self.flush(max(SCATTER, 32 << self.flat))

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if sum(len(x[1]) for x in self.rare) >= least:
            yield _batch(list(_scatter(*map(np.concatenate, zip(*self.rare)), self.flat)))
            self.rare.clear()
        if sum(len(x[1]) for x in self.known) >= least:
            yield _batch(list(_dealt(*map(np.concatenate, zip(*self.known)), 1 << self.bits, 2)))
            self.known.clear()


def shingle_sets(docs: DataFrame, bits: int, width: int, common: Common, flat: int = FLAT) -> DataFrame:
    """Packed segments of all documents, and their number, doc_id and fingerprint of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        scatter = _Scatter(bits, flat, common)
        for batch in batches:
            texts = views(batch.column(1))
            ids = batch.column(0)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(texts):
                doc, tokens = shingle_hashes(texts[a:b], width)
                uid = first + np.arange(a, b)
                if b - a == 1:
                    n, step = np.array([len(tokens)]), 1 << 20
                    total = tokens.sum(dtype=np.uint64, keepdims=True)
                    other = sum((mix64(tokens[k : k + step]).sum(dtype=np.uint64, keepdims=True) for k in range(0, len(tokens), step)), np.zeros(1, np.uint64))
                else:
                    n = np.bincount(doc, minlength=b - a)
                    total, other = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                    np.add.at(total, doc, tokens)
                    np.add.at(other, doc, mix64(tokens))
                more = np.stack([ids[a:b].astype(np.int64), null[a:b].astype(np.int64), total.view(np.int64), other.view(np.int64)], axis=1)
                yield _batch([_row(int(_bucket(uid[:1], 1 << bits)[0]), 1, uid, n, more=more.astype("<i8").tobytes())])
                for k in range(0, len(tokens), SCATTER):  # a long text's shingles go on their way in parts
                    yield from scatter.add(uid[doc[k : k + SCATTER]], tokens[k : k + SCATTER])
            first += len(texts)
        yield from scatter.flush()
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, _PACK)


def _repack(reps: DataFrame, bits: int, common: Common, flat: int = FLAT) -> DataFrame:
    """Packed segments of documents that come with their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = _Scatter(bits, flat, common)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                uid, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                cells = part.column(2).to_pylist()
                tokens = np.frombuffer(b"".join(cells), "<u8")
                owner = np.repeat(uid, [len(c) // 8 for c in cells])
                yield _batch([_row(int(_bucket(uid[:1], 1 << bits)[0]), 1, uid, n)])
                yield from scatter.add(owner, tokens)
        yield from scatter.flush()
        trim()

    return reps.select("uid", "n", "tokens").mapInArrow(run, _PACK)


def _may_link(n: np.ndarray, m: np.ndarray, most: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m that share at most `most` can reach the threshold."""
    return (100 + percent) * most >= percent * (n + m)


def _prefixes(reps: DataFrame, percent: int) -> DataFrame:
    """(token, uid, n, left, df, rank): each prefix shingle with the number of shingles from it on; rank is less the more
    documents have the document's shingles on average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, n, tokens, df in zip(*(batch.column(i).to_pylist() for i in range(4))):
                tokens = np.frombuffer(tokens, "<u8")
                alone = n - len(tokens)
                size = min(n - -(-percent * n // 100) + 1 - alone, len(tokens))
                if size > 0:
                    df = np.frombuffer(df, "<i4")
                    rank = -(1000 * int(df.sum(dtype=np.int64)) // n)
                    rows.append((tokens[:size].view(np.int64), np.full(size, uid), np.full(size, n), n - alone - np.arange(size), df[:size], np.full(size, rank)))
            joined = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in joined], names=["token", "uid", "n", "left", "df", "rank"])

    return reps.select("uid", "n", "tokens", "df").mapInArrow(run, "token long, uid long, n long, left long, df long, rank long")


def _leader_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): every document with the leader under each of its prefix shingles.

    The leader is the one whose shingles most documents have: near copies of one text are nearer to it than to each other."""
    least = prefixes.groupBy("token").agg(F.min(F.struct("rank", "uid", "n", "left")).alias("l"))
    x = prefixes.join(least, "token").where((F.col("uid") != F.col("l.uid")) & ((100 + percent) * F.least("left", "l.left") >= percent * (F.col("n") + F.col("l.n"))))
    return x.select(F.col("l.uid").alias("a"), F.col("uid").alias("b")).distinct()


def _cross_pairs(prefixes: DataFrame, classes: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, b): documents of different classes that share a prefix shingle, if the positional filter lets them."""
    x = prefixes.join(classes, F.col("uid") == F.col("node"), "left").withColumn("class", F.coalesce("component", "uid")).drop("node", "component")
    mixed = x.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("token")
    x = x.join(mixed, "token", "left_semi")
    # A shingle of many documents is dealt to one group per two shares of them, so no task holds more than two shares.
    share = F.pmod(F.xxhash64("uid"), F.greatest(F.lit(1), F.ceil(F.col("df") / HEAVY))).cast("int")
    other = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("df") / HEAVY)).cast("int") - 1)
    x = x.withColumn("share", share).withColumn("other", F.explode(other))
    x = x.withColumn("run", F.xxhash64("token", F.least("share", "other"), F.greatest("share", "other")))
    x = x.withColumn("part", F.pmod(F.col("run"), F.lit(parts)))

    def run(table: pa.Table) -> pa.Table:
        run_, uid, n, left, group = (table[c].to_numpy() for c in ("run", "uid", "n", "left", "class"))
        order = np.lexsort((uid, run_))
        run_, uid, n, left, group = run_[order], uid[order], n[order], left[order], group[order]
        found = np.zeros((0, 2), np.int64)
        held: list[np.ndarray] = []
        for s, k in zip(*_runs(run_)):
            u, size, rest, g = uid[s : s + k], n[s : s + k], left[s : s + k], group[s : s + k]
            step = max(1, (1 << 20) // k)
            for i in range(0, k, step):
                a = slice(i, min(k, i + step))
                good = (u[a, None] < u) & (g[a, None] != g) & _may_link(size[a, None], size, np.minimum(rest[a, None], rest), percent)
                x, y = np.nonzero(good)
                if len(x):
                    held.append(np.stack([u[a][x], u[y]], axis=1))
            if sum(map(len, held)) > 1 << 20:
                found, held = np.unique(np.concatenate([found, *held]), axis=0), []
        found = np.unique(np.concatenate([found, *held]), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    pairs = x.select("part", "run", "uid", "n", "left", "class").groupBy("part").applyInArrow(run, "a long, b long")
    return pairs.distinct()


def _verified(pairs: DataFrame, reps: DataFrame, percent: int, parts: int, star: bool, fragments: int = 4) -> DataFrame:
    """The pairs that reach the threshold: overlaps are counted in each fragment of the order and summed.

    Pairs of stars (a with many b) are dealt by b, so that a leader's are spread over all tasks; others by the square of both
    ends' hashes, so that no document's pairs meet in one task and none is sent to more than two sides of the square."""
    side = max(1, int(parts**0.5))
    square = F.pmod(F.xxhash64("a"), F.lit(side)) * side + F.pmod(F.xxhash64("b"), F.lit(side))
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)) if star else square)
    need = pairs.select("part", F.col("a").alias("uid")).unionByName(pairs.select("part", F.col("b").alias("uid"))).distinct()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, uid, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tokens = np.frombuffer(tokens, "<u8")
                at = (tokens >> np.uint64(40)) % np.uint64(fragments)
                rows += [(part, f, uid, None, np.sort(tokens[at == f]).tobytes()) for f in range(fragments)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "fragment", "a", "b", "tokens"])

    kind = "part long, fragment int, a long, b long, tokens binary"
    held = need.join(reps.select("uid", "tokens"), "uid").select("part", "uid", "tokens").mapInArrow(segments, kind)
    asked = pairs.select("part", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment"), "a", "b", F.lit(None).cast("binary").alias("tokens"))

    def run(table: pa.Table) -> pa.Table:
        is_pair = table["b"].is_valid().to_numpy()
        rows = table.filter(pa.array(~is_pair))
        own = {u: np.frombuffer(t, "<u8") for u, t in zip(rows["a"].to_pylist(), rows["tokens"].to_pylist())}
        asked = table.filter(pa.array(is_pair))
        a, b = asked["a"].to_numpy(), asked["b"].to_numpy()
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        common = np.zeros(len(a), np.int64)
        for s, k in zip(*_runs(a)):
            mine = own[a[s]]
            if len(mine):
                for i in range(s, s + k):
                    theirs = own[b[i]]
                    at = np.searchsorted(mine, theirs)
                    common[i] = np.count_nonzero(mine[np.minimum(at, len(mine) - 1)] == theirs)
        return pa.table({"a": a, "b": b, "common": common})

    counts = asked.unionByName(held).groupBy("part", "fragment").applyInArrow(run, "a long, b long, common long")
    counts = counts.groupBy("a", "b").agg(F.sum("common").alias("common"))
    size = reps.select("uid", "n")
    x = counts.join(size.withColumnRenamed("n", "n_a"), F.col("a") == F.col("uid")).drop("uid").join(size.withColumnRenamed("n", "n_b"), F.col("b") == F.col("uid")).drop("uid")
    return x.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b", "common")


def _representatives(docs: DataFrame, width: int, percent: int, flat: int, fragment: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """All rows with their sets' fingerprints, one uid (rep) for each set that may have a partner, those sets, and a number of tasks."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // fragment).bit_length())
    common = common_shingles(docs, width)
    sets = cut(_supported(shingle_sets(docs, bits, width, common, flat), bits, percent, 4, False, flat), "sets")
    alike = cut(sets.where("tokens IS NOT NULL").groupBy("n", "m2", "m3").agg(F.min("uid").alias("rep"), F.count("*").alias("copies")), "alike")
    reps = sets.join(alike.select("rep"), F.col("uid") == F.col("rep"), "left_semi")
    reps = cut(_supported(_repack(reps, bits, common, flat), bits, percent, 0, True, flat).where("tokens IS NOT NULL"), "reps")
    return sets, alike, reps, max(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _members(sets: DataFrame, class_of: DataFrame, kind: DataType) -> DataFrame:
    """uid, doc_id, n and class of every row; class_of has (n, m2, m3, class) of the sets that may have a partner."""
    x = sets.select("uid", "n", "m2", "m3", F.when(F.col("m1") == 0, F.col("m0")).cast(kind).alias("doc_id"), F.col("tokens").isNotNull().alias("linked"))
    x = x.join(class_of.withColumn("linked", F.lit(True)), ["n", "m2", "m3", "linked"], "left")
    return x.select("uid", "doc_id", "n", F.coalesce("class", "uid").alias("class"))


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, flat: int = FLAT, fragment: int = FRAGMENT_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the classes that links of Jaccard similarity >= percent % form."""
    kind = docs.schema["doc_id"].dataType
    with scratch() as keep:
        sets, alike, reps, parts = _representatives(docs, width, percent, flat, fragment)
        prefixes = cut(_prefixes(reps, percent), "prefixes")
        found = cut(_verified(_leader_pairs(prefixes, percent), reps, percent, parts, True), "links")
        edges = found.select(F.col("a").alias("u"), F.col("b").alias("v"))
        classes = cut(components(edges), "classes")
        more = cut(_verified(_cross_pairs(prefixes, classes, percent, parts), reps, percent, parts, False), "links")
        every = cut(components(edges.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))), "classes")
        class_of = alike.join(every, F.col("rep") == F.col("node"), "left").select("n", "m2", "m3", F.coalesce("component", "rep").alias("class"))
        x = keep(cut(_members(sets, class_of, kind), "members"))
        # Written, so that the join with it can split a class of many rows.
        least = keep(cut(x.groupBy("class").agg(F.min("doc_id").alias("component_id")), "least"))
    return x.join(least, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def similar_pairs(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The join itself: (a, b, common), every pair of different sets that reach the threshold, and (uid, doc_id, n_shingles, rep),
    every row with the set that stands for it. Rows of one rep are links of each other as well. Its cost grows with the pairs."""
    kind = docs.schema["doc_id"].dataType
    with scratch() as keep:
        sets, alike, reps, parts = _representatives(docs, width, percent, FLAT, FRAGMENT_BYTES)
        prefixes = cut(_prefixes(reps, percent), "prefixes")
        alone = docs.sparkSession.createDataFrame([], "node long, component long")
        pairs = keep(cut(_verified(_cross_pairs(prefixes, alone, percent, parts), reps, percent, parts, False), "links"))
        members = keep(cut(_members(sets, alike.select("n", "m2", "m3", F.col("rep").alias("class")), kind), "members"))
    return pairs, members.select("uid", "doc_id", F.col("n").alias("n_shingles"), F.col("class").alias("rep"))

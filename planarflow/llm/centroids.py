"""Centroid clustering with Yinyang bounds: Lloyd's rounds, in which most distances are never computed, with exact results.

The centroids are put into groups once, by their own small clustering. Each vector keeps its cluster, an upper bound on the distance
to that centroid and one lower bound per group on the distances to the group's other centroids. When the centroids have moved, the
upper bound grows by its centroid's shift and each lower bound shrinks by its group's largest shift. A vector whose upper bound lies
below all of its lower bounds keeps its cluster; else the upper bound is made exact and the groups are filtered by it one by one; the
centroids of the groups that are left are all compared. Bounds exclude only what is farther for certain, so that ties go to the
smaller number as in a full scan. Components are whole numbers, and so are squared distances, sums and means: results do not
depend on how rows are dealt.

Each round is one pass over a table of vectors with their bounds, written anew in the shared folder, so that a lost executor costs
its tasks only. A task also writes the changes of its vectors to each cluster's sum; the driver adds these up, clusters times
dimensions numbers per round whatever the input. No vector is shuffled, and a cluster of any size is summed where its vectors are.

Kept are vectors of `dims` components, none null or not finite; other rows give no row. Repeated rows and repeated or null vec_ids
are rows of their own (a null is hashed as an empty string; equal hashes are ordered by their components). With fewer vectors than
clusters each starts one; an empty table gives an empty table. Components beyond 2^27 steps overflow squared distances in 64 bits and
raise an error. Labels and further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, scratch, small_batches

DIMS, CLUSTERS, ROUNDS, SCALE, SALT = 64, 40, 5, 256, 2
#: Centroids of a group, on average; rounds of the grouping.
GROUP, GROUPING = 10, 5
#: Relative margin of the bounds, far above their rounding.
MARGIN = 1e-9
_STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>, squared long, moved long, change array<long>"


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components in whole steps of 1 / scale, of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = (F.size("embedding") == dims) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    steps = F.transform(x, lambda c: F.when(F.abs(c * scale) < 1 << 27, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large for whole squared distances"))).cast("int"))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), steps.alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, salt: int = SALT) -> np.ndarray:
    """The vectors of the least hashes, in their order."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(name, "v").limit(clusters).select("v").collect()
    return np.array([r[0] for r in rows], np.int64)


def squared_gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors: by products in double precision where these hold them, else in 64 bits."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return np.rint(np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    if 4 * x.shape[1] * most * most >= 1 << 63:
        raise OverflowError("squared distances do not fit 64 bits")
    return np.stack([own_gaps(x, np.broadcast_to(row, x.shape)) for row in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


def own_gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def grouped(centroids: np.ndarray, size: int = GROUP) -> list[np.ndarray]:
    """Groups of centroids near each other: their numbers, ascending."""
    count = max(1, len(centroids) // size)
    middle = centroids[np.linspace(0, len(centroids) - 1, count).astype(int)].astype(np.float64)
    for _ in range(GROUPING):
        near = ((centroids[:, None, :] - middle[None]) ** 2).sum(-1).argmin(1)
        middle = np.stack([centroids[near == g].mean(0) if (near == g).any() else middle[g] for g in range(count)])
    return [found for g in range(count) if len(found := np.flatnonzero(near == g))]


class Bounds:
    """Clusters of a batch of vectors with their bounds, brought up to date with centroids that have moved."""

    def __init__(self, x: np.ndarray, groups: list[np.ndarray], cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.x, self.groups, self.cluster, self.upper, self.lower = x, groups, cluster, upper, lower
        self.of = np.empty(sum(map(len, groups)), np.int64)
        for g, members in enumerate(groups):
            self.of[members] = g
        self.scanned = 0  # distances computed

    def move(self, centroids: np.ndarray, shift: np.ndarray | None) -> None:
        """Assign to the centroids' new places; without a shift, for the first time."""
        rows = np.arange(len(self.x))
        if shift is None:
            self.cluster = np.zeros(len(rows), np.int64)
            self.lower = np.full((len(rows), len(self.groups)), -np.inf)
            self.upper = np.full(len(rows), np.inf)
        else:
            self.upper = self.upper + shift[self.cluster]
            self.lower = self.lower - np.array([shift[g].max() for g in self.groups])
            rows = rows[self.lower.min(1) <= self.upper * (1 + MARGIN)]
        if not len(rows):
            return
        own = own_gaps(self.x[rows], centroids[self.cluster[rows]])
        self.scanned += len(rows)
        self.upper[rows] = np.sqrt(own)
        open_ = self.lower[rows] <= self.upper[rows, None] * (1 + MARGIN)
        some = open_.any(1)
        self._scan(rows[some], own[some], open_[some], centroids)

    def _scan(self, rows: np.ndarray, own: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> None:
        """Compare with all centroids of the open groups."""
        before, best, least = self.cluster[rows], self.cluster[rows].copy(), own.copy()
        found = []
        for g, members in enumerate(self.groups):
            at = np.flatnonzero(open_[:, g])
            gaps = squared_gaps(self.x[rows[at]], centroids[members])
            self.scanned += gaps.size
            first = gaps.argmin(1) if len(at) else np.zeros(0, np.int64)
            nearest = gaps[np.arange(len(at)), first]
            gaps[np.arange(len(at)), first] = np.iinfo(np.int64).max
            second = np.where(len(members) > 1, np.sqrt(gaps.min(1, initial=np.iinfo(np.int64).max)), np.inf)
            number = members[first]
            found.append((at, number, np.sqrt(nearest), second))
            closer = (nearest < least[at]) | ((nearest == least[at]) & (number < best[at]))
            best[at[closer]], least[at[closer]] = number[closer], nearest[closer]
        left = (best != before) & ~open_[np.arange(len(rows)), self.of[before]]
        gone = rows[left]
        self.lower[gone, self.of[before[left]]] = np.minimum(self.lower[gone, self.of[before[left]]], np.sqrt(own[left]))
        for g, (at, number, nearest, second) in enumerate(found):
            self.lower[rows[at], g] = np.where(number == best[at], second, nearest)
        self.cluster[rows], self.upper[rows] = best, np.sqrt(least)


def _changes(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """What moved vectors add to and take from each cluster: numbers and sums."""
    number, total = np.zeros(count, np.int64), np.zeros((count, x.shape[1]), np.int64)
    moved = np.arange(len(x)) if before is None else np.flatnonzero(before != after)
    for sign, names in ((1, after), (-1, before)):
        if names is None or not len(moved):
            continue
        order = moved[np.argsort(names[moved], kind="stable")]
        held, first = np.unique(names[order], return_index=True)
        number[held] += sign * np.diff(np.r_[first, len(order)])
        total[held] += sign * np.add.reduceat(x[order], first, axis=0)
    return number, total


def _round(state: DataFrame, centroids: np.ndarray, groups: list[np.ndarray], shift: np.ndarray | None, last: bool) -> DataFrame:
    """State with the clusters for these centroids; further rows hold the changes of each task to the sums."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64())), ("squared", pa.int64()), ("moved", pa.int64()), ("change", pa.list_(pa.int64()))])
    dims, count = centroids.shape[1], len(centroids)

    def lists(flat: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
        ends = pa.array(np.arange(0, flat.size + 1, width, dtype=np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(flat.ravel(), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = np.zeros(count, np.int64), np.zeros((count, dims), np.int64)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dims)
            before = upper = lower = None
            if shift is not None:
                before = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                upper = batch.column("upper").to_numpy(zero_copy_only=False)
                lower = batch.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(n, len(groups))
            bounds = Bounds(x, groups, before if before is None else before.copy(), upper, lower)
            bounds.move(centroids, shift)
            for mine, more in zip((number, total), _changes(x, before, bounds.cluster, count)):
                mine += more
            squared = pa.array(own_gaps(x, centroids[bounds.cluster])) if last else pa.nulls(n, pa.int64())
            kept = [batch.column("vec_id"), pa.nulls(n, schema.field("v").type) if last else batch.column("v").cast(schema.field("v").type), pa.array(bounds.cluster, pa.int32()), pa.array(bounds.upper), lists(bounds.lower, len(groups), pa.float64())]
            yield pa.RecordBatch.from_arrays([*kept, squared, pa.nulls(n, pa.int64()), pa.nulls(n, schema.field("change").type)], schema=schema)
        touched = np.flatnonzero((number != 0) | (total != 0).any(1))
        if len(touched) and not last:
            n = len(touched)
            none = [pa.nulls(n, schema.field(k).type) for k in ("vec_id", "v")]
            more = [pa.nulls(n, schema.field(k).type) for k in ("upper", "lower", "squared")]
            yield pa.RecordBatch.from_arrays([*none, pa.array(touched, pa.int32()), *more, pa.array(number[touched]), lists(total[touched], dims, pa.int64())], schema=schema)

    return state.mapInArrow(run, _STATE)


def _add(state: DataFrame, number: list[int], total: list[list[int]]) -> None:
    """Add the changes that the tasks found to the clusters' numbers and sums, as whole numbers of any size."""
    rows = state.where("moved IS NOT NULL").select("cluster", "moved", F.posexplode("change").alias("place", "c"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    for r in rows.groupBy("cluster", "place").agg(wide("moved").alias("n"), wide("c").alias("c")).collect():
        total[r.cluster][r.place] += int(r.c)
        if not r.place:
            number[r.cluster] += int(r.n)


def cluster(vectors: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, salt: int = SALT, group: int = GROUP) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, squared distance) of each vector that takes part, and the final centroids."""
    spark = vectors.sparkSession
    small_batches(spark)
    state = whole_vectors(vectors, dims, scale)
    centroids = first_centroids(state, clusters, salt)
    if not len(centroids):
        return state.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64)
    groups = grouped(centroids, group)
    number, total = [0] * len(centroids), [[0] * dims for _ in centroids]
    shift = None
    with scratch() as keep:
        for _ in range(rounds):
            new = cut(_round(state, centroids, groups, shift, False), "round")
            _add(new, number, total)
            release(state)
            state = new.where("moved IS NULL")
            state._planarflow_path = new._planarflow_path
            moved = np.array([[s // n for s in t] if n else c.tolist() for c, n, t in zip(centroids, number, total)], np.int64)
            shift = np.sqrt(own_gaps(moved, centroids).astype(np.float64)) * (1 + MARGIN)
            centroids = moved
        final = keep(cut(_round(state, centroids, groups, shift, True), "clusters"))
    return final.select("vec_id", "cluster", F.col("squared").alias("distance")), centroids


def cluster_digests(vectors: DataFrame, **more) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = cluster(vectors, **more)
    own = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # one row per cluster: bounded by a parameter
    facts = [(i, own[i], sum(own.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist()) if i in own]
    named = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

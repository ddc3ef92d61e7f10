"""Embedding near-duplicates by cover trees: exact threshold pairs from a dual traversal.

Equal vectors become one. The upper levels of the tree are tables: a cell of more than CELL vectors is split at points far from
each other, chosen from a bounded sample of it, and every vector falls to the nearest; this goes on until the cells are small
or too narrow to be worth it. Cells keep their centre and covering radius. Pairs of cells are followed down these levels by
joins; a pair is dropped if the centres are farther apart than the threshold's distance and both radii, and is linked as a
whole, without comparing its points, if these put every two points within it. Each cell that is left builds cover trees of
at most BLOCK points that lie near each other, whose levels have halving radii and whose nodes keep their exact covering radius;
pairs of nodes are dropped and linked by the same bounds, and what is left is compared by cosine in double precision. The
work on pairs is dealt to one task per pair of cells. A task returns each vector's number of links and a spanning forest of
its links, so what it returns grows with its vectors, not with their pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing; others link with those of their own
length, however small or large their finite components are. Repeated rows link with each other. A null vec_id takes part; a
class's component_id is its least known one. An empty table gives an empty table; labels and further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch
from .components import components

COSINE = 0.9
#: Points of a tree; vectors of a cell and their bytes; margin of bounds on distances.
BLOCK, CELL, CELL_BYTES, MARGIN = 4_096, 16_384, 1 << 23, 1e-5
#: Vectors of a cell's sample, most parts it is split into at once, vectors that one task moves, and levels of cells.
SAMPLE, PARTS, CHUNK, DEPTH = 2_048, 64, 1 << 16, 12
#: Directions that screen single points.
AXES = 24
_PAIR = 1 << 21


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def spread(x: np.ndarray, count: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Greedy centres (the first point, then always the farthest) until count, or until all lie within about least; each point's centre."""
    x = x.astype(np.float32)
    near = x @ x[0]
    near[0] = 2.0
    chosen, owner = [0], np.zeros(len(x), np.int64)
    enough = 1 - least * least / 2
    while len(chosen) < count:
        far = int(near.argmin())
        if near[far] >= enough:
            break
        d = x @ x[far]
        d[far] = 2.0
        closer = d > near
        owner[closer] = len(chosen)
        np.maximum(near, d, out=near)
        chosen.append(far)
    return np.array(chosen), owner


class CoverTree:
    """Points in depth-first order; nodes have a centre, a covering radius, a range of points and children.

    The root's children have radii of top / 2 at most: nodes wider than the reach of a link exclude next to nothing."""

    def __init__(self, x: np.ndarray, top: float = 2.0):
        self._x = x
        self._order: list[int] = []
        self._centre: list[int] = []
        self._radius: list[float] = []
        self._range: list[tuple[int, int]] = []
        self._children: list[list[int]] = []
        self._grow(np.arange(len(x)), top)
        self.order = np.array(self._order)
        place = np.empty(len(x), np.int64)
        place[self.order] = np.arange(len(x))
        self.centre, self.radius = place[np.array(self._centre)], np.array(self._radius)
        self.range = np.array(self._range)
        self.kids = np.concatenate([np.array(k, np.int64) for k in self._children])
        self.kid_ends = np.cumsum([len(k) for k in self._children])
        self.points = x[self.order]

    def _grow(self, members: np.ndarray, level: float) -> int:
        """The node of members, of which the first is the centre and none is farther from it than about level."""
        node, first = len(self._centre), len(self._order)
        self._centre.append(int(members[0]))
        radius = float(gaps(self._x[members], self._x[members[:1]])[1:].max(initial=0.0))
        self._radius.append(radius)
        self._range.append((first, first + len(members)))
        self._children.append([])
        if len(members) == 1:
            self._order.extend(members.tolist())
            return node
        half = level / 2
        while half >= radius and half > 1e-4:
            half /= 2
        if half <= 1e-4:  # closer than single precision tells apart: every point for itself
            chosen, owner = np.arange(len(members)), np.arange(len(members))
        else:
            chosen, owner = spread(self._x[members], len(members), half)
        if len(chosen) == 1:
            chosen, owner = np.arange(len(members)), np.arange(len(members))
        by = np.argsort(owner, kind="stable")
        for c, part in zip(members[chosen], np.split(members[by], np.cumsum(np.bincount(owner, minlength=len(chosen)))[:-1])):
            at = int(np.flatnonzero(part == c)[0])
            part[[0, at]] = part[[at, 0]]
            self._children[node].append(self._grow(part, half))
        return node

    def pack(self) -> dict[str, bytes]:
        """The tree without its points, as columns."""
        return {k: np.ascontiguousarray(getattr(self, k)).tobytes() for k in ("centre", "radius", "range", "kids", "kid_ends")}

    @classmethod
    def unpack(cls, points: np.ndarray, held: dict[str, bytes]) -> CoverTree:
        """A packed tree over its points in its order."""
        t = cls.__new__(cls)
        t.points, t.order = points, np.arange(len(points))
        t.radius = np.frombuffer(held["radius"], np.float64)
        t.centre, t.kids, t.kid_ends = (np.frombuffer(held[k], np.int64) for k in ("centre", "kids", "kid_ends"))
        t.range = np.frombuffer(held["range"], np.int64).reshape(-1, 2)
        return t

    def children(self, node: int) -> np.ndarray:
        """The node's children, itself if it has none."""
        a, b = (self.kid_ends[node - 1] if node else 0), self.kid_ends[node]
        return self.kids[a:b] if b > a else np.array([node])


class _Links:
    """Link counts of the points of two trees, and a spanning forest of the links."""

    def __init__(self, n: int, m: int, weight_a: np.ndarray, weight_b: np.ndarray):
        self.a, self.b = np.zeros(n, np.int64), np.zeros(m, np.int64)
        self.weight_a, self.weight_b, self.n = weight_a, weight_b, n
        self.parent = np.arange(n + m)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        p = self.parent
        while True:
            ru, rv = self.roots(u), self.roots(v)
            apart = ru != rv
            if not apart.any():
                return
            u, v = u[apart], v[apart]
            high, low = np.maximum(ru[apart], rv[apart]), np.minimum(ru[apart], rv[apart])
            np.minimum.at(p, high, low)

    def roots(self, u: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[u]
        while True:
            up = p[r]
            if (up == r).all():
                p[u] = r
                return r
            r = up


def principal(points: np.ndarray, axes: int = AXES) -> np.ndarray:
    """Orthonormal directions in which the points are longest, as columns."""
    return np.linalg.eigh(points.T @ points)[1][:, ::-1][:, :axes]


def _short(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates along the basis and the length of the rest: their products bound those of the points from above."""
    y = x @ basis
    return np.hstack([y, np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", y, y)))[:, None]]).astype(np.float32)


def traverse(a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float, same: bool, basis: np.ndarray | None = None) -> _Links:
    """All links between the points of two trees (of one tree: each pair once).

    Pairs of nodes are screened in single precision with a margin, single points by an upper bound from a few coordinates;
    what is linked is linked by the trees' bounds or by a product in double precision."""
    reach = float(np.sqrt(2 - 2 * cosine))
    out = _Links(len(a.points), len(b.points), weight_a, weight_b)
    ca, cb = a.points[a.centre], b.points[b.centre]
    xa, xb = ca.astype(np.float32), cb.astype(np.float32)
    basis = np.eye(ca.shape[1]) if basis is None else basis
    sa, sb = _short(ca, basis), _short(cb, basis)
    single_a, single_b = a.range[:, 1] - a.range[:, 0] == 1, b.range[:, 1] - b.range[:, 0] == 1
    base = np.float32(cosine - MARGIN)

    def opened(nodes: np.ndarray) -> np.ndarray:
        alone = single_b[nodes]
        return np.concatenate([nodes[alone], *(b.children(m) for m in nodes[~alone])])

    def linked(n: int, nodes: np.ndarray, own: bool) -> None:
        """All points of n link with all of the nodes."""
        u, v = np.arange(*a.range[n]), np.concatenate([np.arange(*b.range[m]) for m in nodes])
        if own:
            out.a[u] += weight_b[v].sum() - weight_b[v]
        else:
            out.a[u] += weight_b[v].sum()
            out.b[v] += weight_a[u].sum()
        out.join(np.full(len(v), u[0]), out.n + v)
        out.join(u, np.full(len(u), out.n + v[0]))

    todo = [(np.array([0]), np.array([0]), same)]
    while todo:
        na, nb, mirror = todo.pop()
        one_a, one_b = a.range[na[single_a[na]], 0], b.range[nb[single_b[nb]], 0]
        right = sb[nb[single_b[nb]]].T
        step = max(1, _PAIR // max(1, len(one_b)))
        for k in range(0, len(one_a), step):
            part = one_a[k : k + step]
            hit = np.flatnonzero(sa[na[single_a[na]][k : k + step]] @ right >= base)
            p, q = part[hit // len(one_b)] if len(hit) else part[:0], one_b[hit % len(one_b)] if len(hit) else one_b[:0]
            if mirror:
                p, q = p[p < q], q[p < q]
            if len(p):
                near = np.concatenate([np.einsum("ij,ij->i", a.points[p[c : c + 65536]], b.points[q[c : c + 65536]]) for c in range(0, len(p), 65536)]) >= cosine
                p, q = p[near], q[near]
                np.add.at(out.a, p, weight_b[q])
                np.add.at(out.b, q, weight_a[p])
                out.join(p, out.n + q)
        for ia, jb in ((na[~single_a[na]], nb), (na[single_a[na]], nb[~single_b[nb]])):
            if not len(ia) or not len(jb):
                continue
            bound = 1 - np.square(np.minimum(2.0, reach + a.radius[ia][:, None] + b.radius[jb])) / 2 - MARGIN
            i, j = np.nonzero(xa[ia] @ xb[jb].T >= bound)
            i, j = ia[i], jb[j]
            if mirror:  # a pair of nodes and its mirror: one of them is enough
                keep = a.range[i, 0] <= b.range[j, 0]
                i, j = i[keep], j[keep]
            own = mirror & (i == j)
            for n in i[own]:
                if 2 * a.radius[n] <= reach - MARGIN:
                    linked(n, np.array([n]), True)
                else:
                    todo.append((a.children(n), b.children(n), True))
            i, j = i[~own], j[~own]
            wide = ~single_a[i]
            for n in np.unique(i[wide]):
                others = j[i == n]
                gap = gaps(a.points[a.centre[n]][None], b.points[b.centre[others]])[0]
                inside = gap + a.radius[n] + b.radius[others] <= reach - MARGIN
                if inside.any():
                    linked(n, others[inside], False)
                if not inside.all():
                    todo.append((a.children(n), opened(others[~inside]), False))
            i, j = i[~wide], j[~wide]
            for m in np.unique(j):
                todo.append((i[j == m], b.children(m), False))
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    e = F.col("embedding")
    dead = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    sound = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, dead) & F.exists(e, lambda v: v != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), e).alias("embedding"))
    rows = cut(rows.withColumn("embedding", F.col("embedding").cast("array<double>")), "vectors")
    widths = [r["n"] for r in rows.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").collect()] or [0]
    whole = len(widths) == 1
    parts = [_of_one_length(rows if whole else rows.where((F.size("embedding") == n) | (F.col("embedding").isNull() if n == widths[0] else F.lit(False))), n, cosine, block, cell) for n in widths]
    return reduce(DataFrame.unionByName, parts)


_FALLEN = "rep long, copies long, embedding array<double>, cell string, gap double"


def _split(vectors: DataFrame, level: int, cell: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The vectors (rep, copies, embedding, cell, n) of cells that are split, each in its new cell, and the new cells' centres."""

    def choose(t: pa.Table) -> pa.Table:
        x = _vectors(t["embedding"].combine_chunks())
        n = t["n"][0].as_py()
        order = np.argsort(t["rep"].to_numpy())  # the same centres whatever the order of rows
        centres = x[order][spread(unit(x[order]), max(2, min(PARTS, 2 * -(-n // cell))), least)[0]]
        return pa.table({"cell": pa.array([t["cell"][0].as_py()] * len(centres)), "part": pa.array(np.arange(len(centres)), pa.int32()), "centre": pa.array(list(centres), pa.list_(pa.float64()))})

    chance = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(level), "rep")), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    centres = vectors.where(chance * F.col("n") < SAMPLE).groupBy("cell").applyInArrow(choose, "cell string, part int, centre array<double>")
    centres = cut(centres, "centres")
    # A cell's vectors are moved by several tasks; each gets the cell's centres.
    salts = F.ceil(F.col("n") / CHUNK).cast("int")
    asked = vectors.select("cell", salts.alias("salts")).distinct().join(centres, "cell").select(F.col("cell").alias("of"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("turn"), "part", "centre")
    moved = vectors.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(level)), salts).cast("int"))

    def fall(t: pa.Table, c: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "copies": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float64())), "cell": pa.array([], pa.string()), "gap": pa.array([], pa.float64())})
        part = c["part"].to_numpy()
        centre = unit(_vectors(c["centre"].combine_chunks()))[np.argsort(part)]
        d = gaps(unit(_vectors(t["embedding"].combine_chunks())), centre)
        name = t["cell"][0].as_py()
        return pa.table({"rep": t["rep"], "copies": t["copies"], "embedding": t["embedding"], "cell": pa.array([f"{name}.{k}" for k in d.argmin(axis=1)]), "gap": pa.array(d.min(axis=1), pa.float64())})

    new = moved.groupBy("cell", "salt").cogroup(asked.groupBy("of", "turn")).applyInArrow(fall, _FALLEN)
    return cut(new, "cells"), centres.select(F.concat_ws(".", "cell", F.col("part").cast("string")).alias("cell"), F.col("cell").alias("parent"), "centre")


def _cells(alike: DataFrame, cell: int, reach: float) -> tuple[DataFrame, list[DataFrame]]:
    """Vectors by their last cell, and the cells of each level: cell, parent, centre, radius, n, copies, root (least rep), split."""
    total = (F.count("*").alias("n"), F.max("gap").alias("radius"), F.sum("copies").alias("copies"), F.min("rep").alias("root"))
    open_ = alike.select("rep", "copies", "embedding", F.lit("0").alias("cell"), F.lit(2.0).alias("gap"))
    done: list[DataFrame] = []
    levels: list[DataFrame] = []
    centres = None
    while True:
        stats = open_.groupBy("cell").agg(*total)
        centre = F.lit(None).cast("array<double>")
        stats = stats.join(centres, "cell") if centres is not None else stats.withColumn("parent", F.lit("")).withColumn("centre", centre)
        wide = (F.col("n") > cell) & (F.col("radius") > reach / 4) & F.lit(len(levels) < DEPTH)
        stats = cut(stats.withColumn("split", wide), "levels")
        levels.append(stats)
        big = stats.where("split").select("cell", "n")
        if big.isEmpty():
            done.append(open_)
            return reduce(DataFrame.unionByName, done), levels
        if len(levels) > 1:
            done.append(open_.join(big, "cell", "left_anti"))
        open_, centres = _split(open_.drop("gap").join(big, "cell"), len(levels), cell, reach / 8)


def _near_cells(levels: list[DataFrame], reach: float) -> DataFrame:
    """Pairs (a, b, whole) of last cells that may hold links, by following pairs of cells down the levels."""
    own = ("cell", "centre", "radius")
    pairs = levels[0].select(F.col("cell").alias("a"), F.col("cell").alias("b"), F.lit(False).alias("whole"))
    last = levels[0].where("NOT split")
    for stats in levels[1:]:
        kids = stats.select(F.col("parent").alias("p"), *own).unionByName(last.select(F.col("cell").alias("p"), *own))
        x = pairs.join(kids.select(F.col("p").alias("a"), F.struct(*own).alias("x")), "a").join(kids.select(F.col("p").alias("b"), F.struct(*own).alias("y")), "b")
        x = x.where((F.col("a") != F.col("b")) | (F.col("x.cell") <= F.col("y.cell")))
        unit_ = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
        dot = F.aggregate(F.zip_with("x.centre", "y.centre", lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
        gap = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot / (unit_(F.col("x.centre")) * unit_(F.col("y.centre")))))
        x = x.withColumn("gap", F.when(F.col("x.cell") == F.col("y.cell"), F.lit(0.0)).otherwise(gap))
        far = F.col("x.radius") + F.col("y.radius")
        # A centre whose squares overflow gives no gap; such a pair is kept.
        x = x.where((F.col("x.cell") == F.col("y.cell")) | ~F.coalesce(F.col("gap") > reach + far + MARGIN, F.lit(False)))
        pairs = cut(x.select(F.least("x.cell", "y.cell").alias("a"), F.greatest("x.cell", "y.cell").alias("b"), F.coalesce(F.col("gap") + far <= reach - MARGIN, F.lit(False)).alias("whole")), "near")
        last = last.unionByName(stats.where("NOT split"))
    return pairs


def _whole_links(fallen: DataFrame, last: DataFrame, whole: DataFrame) -> DataFrame:
    """(rep, links, root) of all vectors in pairs of cells that are linked as a whole."""
    both = whole.select("a", "b").unionByName(whole.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = last.select(F.col("cell").alias("b"), "copies", "root")
    # Every vector of a links with all of b: with b's root, and the roots of all such b with a's.
    sums = both.join(known, "b").groupBy("a").agg(F.sum("copies").alias("add"), F.min("root").alias("to"), F.max((F.col("a") == F.col("b")).cast("int")).alias("own"))
    each = fallen.join(sums, F.col("cell") == F.col("a")).select("rep", (F.col("add") - F.when(F.col("own") == 1, F.col("copies")).otherwise(0)).alias("links"), F.col("to").alias("root"))
    mine = last.select(F.col("cell").alias("a"), F.col("root").alias("rep"))
    roots = both.join(known, "b").join(mine, "a").select("rep", F.lit(0).cast("long").alias("links"), "root")
    return each.unionByName(roots)


def _of_one_length(rows: DataFrame, usual: int, cosine: float, block: int, cell: int) -> DataFrame:
    """near_duplicates() of rows whose vectors have usual components or are null."""
    alike = rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    alike = cut(alike.withColumn("rep", F.monotonically_increasing_id()), "reps")
    count = alike.count()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    with scratch() as keep:
        known = keep(cut(_linked(alike, usual, cosine, block, max(2, min(cell, CELL_BYTES // (8 * usual)))), "links"))
    out = rows.join(known, "embedding", "left")
    component = F.when(F.col("embedding").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _linked(alike: DataFrame, usual: int, cosine: float, block: int, cell: int) -> DataFrame:
    """embedding, n_links and component_id of distinct vectors (embedding, least vec_id, copies, rep)."""
    reach = float(np.sqrt(2 - 2 * cosine))
    sample = alike.orderBy(F.xxhash64("embedding"), "rep").limit(4 * SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    basis = principal(unit(_vectors(sample)))
    fallen, levels = _cells(alike, cell, reach)
    near = _near_cells(levels, reach)
    last = reduce(DataFrame.unionByName, levels).where("NOT split").select("cell", "n", "copies", "root")
    # Cells that stay large (DEPTH) are dealt in shares; pairs of shares meet in one task.
    shares = last.select("cell", F.ceil(F.col("n") / cell).cast("int").alias("shares"))
    mine = lambda side: shares.select(F.col("cell").alias(side), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias(f"s{side}"))
    pairs = near.where("NOT whole").join(mine("a"), "a").join(mine("b"), "b").where("a < b OR sa <= sb")
    pairs = cut(pairs.select(F.struct(F.col("a").alias("cell"), F.col("sa").alias("share")).alias("x"), F.struct(F.col("b").alias("cell"), F.col("sb").alias("share")).alias("y")), "pairs")
    met = pairs.select("x.cell").unionByName(pairs.select("y.cell")).distinct()
    blocks = fallen.join(shares.join(met, "cell"), "cell").withColumn("share", F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int"))

    tree_columns = ("centre", "radius", "range", "kids", "kid_ends")
    kind = "cell string, share int, reps binary, copies binary, data binary, " + ", ".join(f"{c} binary" for c in tree_columns)

    def packed(t: pa.Table) -> pa.Table:
        x = np.ascontiguousarray(_vectors(t["embedding"].combine_chunks()))
        rep, copies = t["rep"].to_numpy(), t["copies"].to_numpy()
        owner = np.zeros(len(x), np.int64)
        if len(x) > block:  # trees of points that lie near each other, none of more than block
            owner = spread(unit(x), 2 * -(-len(x) // block))[1]
            order = np.argsort(owner, kind="stable")
            start = np.r_[0, np.flatnonzero(np.diff(owner[order])) + 1]
            place = np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)]))
            owner[order] = owner[order] * len(x) + place // block
        rows = []
        for k in np.unique(owner):
            at = np.flatnonzero(owner == k)
            tree = CoverTree(unit(x[at]), reach)
            at = at[tree.order]
            short = x[at].astype(np.float32)
            rows.append({"reps": rep[at].tobytes(), "copies": copies[at].tobytes(), "data": (short if (short == x[at]).all() else x[at]).tobytes()} | tree.pack())
        names = {"cell": pa.array([t["cell"][0].as_py()] * len(rows)), "share": pa.array([t["share"][0].as_py()] * len(rows), pa.int32())}
        return pa.table(names | {k: pa.array([r[k] for r in rows], pa.binary()) for k in ("reps", "copies", "data", *tree_columns)})

    held = cut(blocks.select("cell", "share", "rep", "copies", "embedding").groupBy("cell", "share").applyInArrow(packed, kind), "blocks")
    sent = ("reps", "copies", "data", *tree_columns)
    held = held.select(F.struct("cell", "share").alias("block"), *sent)
    left = pairs.join(held, F.col("x") == F.col("block")).select("x", "y", F.lit(0).alias("side"), *sent)
    right = pairs.where("x <> y").join(held, F.col("y") == F.col("block")).select("x", "y", F.lit(1).alias("side"), *sent)

    def link(t: pa.Table) -> pa.Table:
        sides: dict[int, list[tuple]] = {0: [], 1: []}
        for row in t.select(["side", *sent]).to_pylist():
            reps = np.frombuffer(row["reps"], np.int64)
            data = np.frombuffer(row["data"], np.float32 if len(row["data"]) == 4 * usual * len(reps) else np.float64)
            sides[row["side"]].append((reps, np.frombuffer(row["copies"], np.int64), CoverTree.unpack(unit(data.reshape(len(reps), -1)), row)))
        alone = not sides[1]
        out: list[tuple] = []
        for i, (ra, wa, ta) in enumerate(sides[0]):
            for j, (rb, wb, tb) in enumerate(sides[0] if alone else sides[1]):
                if alone and j < i:
                    continue
                same = alone and i == j
                found = traverse(ta, tb, wa, wb, cosine, same, basis)
                if same:  # both halves are the same points
                    found.join(np.arange(len(ra)), len(ra) + np.arange(len(ra)))
                rep, links = np.concatenate([ra, rb]), np.concatenate([found.a, found.b])
                root = rep[found.roots(np.arange(len(rep)))]
                some = links > 0
                out.append((rep[some], links[some], root[some]))
        return pa.table({k: pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i, k in enumerate(("rep", "links", "root"))})

    links = left.unionByName(right).groupBy("x", "y").applyInArrow(link, "rep long, links long, root long")
    links = cut(links.unionByName(_whole_links(fallen, last, near.where("whole"))), "links")
    classes = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    total = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = alike.join(total, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left")
    known = known.withColumn("class", F.coalesce("component", "rep"))
    least = known.groupBy("class").agg(F.min("least").alias("component_id"))
    return known.join(least, "class").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")

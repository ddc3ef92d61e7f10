"""Canonical forms under a stage's symmetries, and the cheap invariants that come before them.

The canonical form is the largest relabeling of a drawing. Permutations are thinned out first: those that give the largest
vector of crossing counts by edge, then the largest set of crossings; only what is left is relabeled in full. A form is
packed into bytes that sort as it does and hold the whole drawing, so it serves as grouping key and as representative.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

from planarflow.functions.drawing import Drawing, canonical_cycle
from planarflow.plans.graph import Census, Points

_END, _FACES = 0xFF, 0xFE


def pack(paths: Sequence[tuple[int, tuple[int, ...]]], faces: Sequence[tuple[int, ...]]) -> bytes:
    out = bytearray()
    for e, path in paths:
        out += bytes((e, *path, _END))
    out.append(_FACES)
    for f in faces:
        out += bytes((*f, _END))
    return bytes(out)


def unpack(data: bytes) -> Drawing:
    paths, _, faces = data.partition(bytes([_FACES]))
    rows = [tuple(p) for p in paths.split(b"\xff")[:-1]]
    return Drawing(tuple((r[0], r[1:]) for r in rows), frozenset(tuple(f) for f in faces.split(b"\xff")[:-1]))


class Canonizer:
    """Canonical forms of drawings on the same edges under one group of point relabelings."""

    def __init__(self, points: Points, group: Sequence[tuple[int, ...]], edges: Sequence[int]):
        n = len(points.vertices)
        self.n, self.points, self.group, self.edges = n, points, group, list(edges)
        where = {e: i for i, e in enumerate(self.edges)}
        self.edge_image = []
        back_e, back_c = np.empty((len(group), len(edges)), np.int64), np.empty((len(group), len(points.crossings)), np.int64)
        for k, move in enumerate(group):
            image = {}
            for e in self.edges:
                u, v = (move[p] for p in points.edges[e])
                image[e] = points.edge_id[(u, v) if u > v else (v, u)]
                back_e[k, where[image[e]]] = where[e]
            self.edge_image.append(image)
            back_c[k, np.array(move[n:], np.int64) - n] = np.arange(len(points.crossings))
        self.back_e, self.back_c = back_e, back_c
        self.weight = np.uint64(16) ** np.arange(len(edges), dtype=np.uint64)[::-1]

    def survivors(self, d: Drawing) -> np.ndarray:
        counts = np.array([len(path) - 2 for _, path in d.paths], np.uint64)
        ranked = (counts[self.back_e] * self.weight).sum(axis=1)
        best = np.flatnonzero(ranked == ranked.max())
        if len(best) > 1:
            here = np.zeros(len(self.points.crossings), bool)
            here[[p - self.n for p in d.crossings(self.n)]] = True
            sets = [r.tobytes() for r in np.packbits(here[self.back_c[best]], axis=1)]
            top = max(sets)
            best = best[[s == top for s in sets]]
        return best

    def form(self, d: Drawing, faces: bool = True) -> bytes:
        """The packed canonical form, without faces if they are not to count."""
        best = b""
        for k in self.survivors(d):
            move, image = self.group[k], self.edge_image[k]
            paths = []
            for e, path in d.paths:
                p = tuple(map(move.__getitem__, path))
                paths.append((image[e], p if p[0] > p[-1] else p[::-1]))
            moved = sorted(canonical_cycle(tuple(map(move.__getitem__, f))) for f in d.faces) if faces else ()
            best = max(best, pack(sorted(paths), moved))
        return best


@lru_cache(maxsize=8)
def canonizer(m: int, n: int, stage: int) -> Canonizer:
    c = Census(m, n)
    return Canonizer(c.points, c.stage_group(stage), sorted(c.points.edge_id[e] for e in c.stage_edges(stage)))


# --- invariants -----------------------------------------------------------------------------------


def path_crossing_counts(d: Drawing) -> list[int]:
    return sorted(len(p) - 2 for _, p in d.paths)


def path_lengths(d: Drawing) -> list[int]:
    return sorted(len(p) for _, p in d.paths)


def face_lengths(d: Drawing) -> list[int]:
    return sorted(len(f) for f in d.faces)


def vertex_signatures(d: Drawing) -> list[tuple[int, tuple[int, ...]]]:
    """Degree and sorted crossing counts of the paths at each vertex, sorted."""
    at: dict[int, list[int]] = {}
    for _, p in d.paths:
        for v in (p[0], p[-1]):
            at.setdefault(v, []).append(len(p) - 2)
    return sorted((len(x), tuple(sorted(x))) for x in at.values())


def crossing_end_degrees(d: Drawing, points: Points) -> list[tuple[int, ...]]:
    """For each crossing the sorted degrees of its four ends, sorted."""
    degree: dict[int, int] = {}
    for _, p in d.paths:
        for v in (p[0], p[-1]):
            degree[v] = degree.get(v, 0) + 1
    return sorted(tuple(sorted(degree.get(v, 0) for e in points.parts[x] for v in points.edges[e])) for x in d.crossings(len(points.vertices)))


_SERIES: dict[str, Callable[[Drawing], list[int]]] = {"path-crossing-count": path_crossing_counts, "path-length": path_lengths, "face-length": face_lengths}
_OF: dict[str, Callable[[list[int]], int]] = {
    "min": lambda x: min(x, default=0),
    "max": lambda x: max(x, default=0),
    "min-multiplicity": lambda x: x.count(min(x)) if x else 0,
    "max-multiplicity": lambda x: x.count(max(x)) if x else 0,
    "distinct-count": lambda x: len(set(x)),
}


def invariant(d: Drawing, name: str, points: Points):
    """One bucket property by name; unknown names raise."""
    n = len(points.vertices)
    plain = {
        "vertex-count": lambda: len({v for _, p in d.paths for v in (p[0], p[-1])}),
        "path-count": lambda: len(d.paths),
        "crossing-count": lambda: len(d.crossings(n)),
        "face-count": lambda: len(d.faces),
        "vertex-incident-path-crossing-counts": lambda: vertex_signatures(d),
        "path-crossing-counts": lambda: path_crossing_counts(d),
        "path-lengths": lambda: path_lengths(d),
        "face-lengths": lambda: face_lengths(d),
        "crossing-endpoint-degrees": lambda: crossing_end_degrees(d, points),
    }
    if name in plain:
        return plain[name]()
    for how, f in _OF.items():
        for series, of in _SERIES.items():
            if name in (f"{how}-{series}", f"{series}-{how}", f"{how.partition('-')[0]}-{series}-{how.partition('-')[2]}"):
                return f(of(d))
    raise ValueError(f"unknown bucket property: {name!r}")


#: Properties that buckets use by default.
DEFAULT_PROPERTIES = ("path-crossing-counts", "face-lengths")


def bucket_key(d: Drawing, points: Points, properties: Sequence[str] | None = None) -> str:
    """The named properties' values as compact JSON; equal for drawings that differ by a relabeling."""
    return json.dumps([[name, invariant(d, name, points)] for name in properties or DEFAULT_PROPERTIES], separators=(",", ":"))


def bucket_hash(d: Drawing, points: Points, properties: Sequence[str] | None = None) -> str:
    return hashlib.sha256(bucket_key(d, points, properties).encode()).hexdigest()


# --- sides ----------------------------------------------------------------------------------------


def crossing_orders(d: Drawing, census: Census) -> tuple[tuple[int, ...], ...]:
    """For each edge the edges that it crosses, in order from side A to side B."""
    points = census.points
    if len(d.paths) != len(points.edges):
        raise ValueError("the drawing lacks edges")
    out = []
    for e, path in sorted(d.paths):
        inner = path[1:-1] if path[0] < census.m else path[-2:0:-1]
        partners = []
        for p in inner:
            pair = points.parts[p]
            if e not in pair:
                raise ValueError(f"point {p} is no crossing of edge {e}")
            partners.append(pair[0] if pair[1] == e else pair[1])
        out.append(tuple(partners))
    return tuple(out)


def side_swap(d: Drawing, census: Census) -> tuple[bool, bool]:
    """Whether the sides' profiles agree, and whether some exchange of the sides keeps all crossing orders."""
    m = census.m
    if m != census.n:
        return False, False
    if m == 2:
        return True, True
    orders = crossing_orders(d, census)
    by_vertex: dict[int, list[int]] = {}
    for (u, v), order in zip(census.points.edges, orders):
        for w in (u, v):
            by_vertex.setdefault(w, []).append(len(order))
    profile = {v: sorted(x) for v, x in by_vertex.items()}
    if sorted(profile[v] for v in range(m)) != sorted(profile[v] for v in range(m, 2 * m)):
        return False, False
    for p in census.group:
        if p[0] < m or any(profile[v] != profile[w] for v, w in enumerate(p)):
            continue
        image = [census.points.edge_id[tuple(sorted((p[u], p[v]), reverse=True))] for u, v in census.points.edges]
        if all(tuple(image[x] for x in reversed(order)) == orders[image[e]] for e, order in enumerate(orders)):
            return True, True
    return True, False

"""The static side of a census: points of K(m,n) as dense integers, the order of construction, and symmetries by stage.

Vertices are 0..m+n-1, the first m on side A. Possible crossings follow, numbered in their lexicographic order, so that
comparing integers compares points. All of this is small and known before a run; drawings are data, this is not.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations

Edge = tuple[int, int]
Crossing = tuple[Edge, Edge]


def edge(u: int, v: int) -> Edge:
    """An edge, its larger end first."""
    if u == v:
        raise ValueError(f"loop at {u}")
    return (u, v) if u > v else (v, u)


def crossing(e: Edge, f: Edge) -> Crossing:
    """A crossing of two edges without a common end, the larger edge first."""
    e, f = edge(*e), edge(*f)
    if {*e} & {*f}:
        raise ValueError(f"edges {e} and {f} share an end")
    return (e, f) if e > f else (f, e)


def complete_bipartite(m: int, n: int) -> tuple[tuple[int, ...], tuple[Edge, ...], tuple[int, ...]]:
    """Vertices, edges (by A, then B) and colors of K(m,n)."""
    if m < 2 or n < 2:
        raise ValueError("both sides need two vertices")
    return tuple(range(m + n)), tuple((a, b) for a in range(m) for b in range(m, m + n)), (1,) * m + (2,) * n


def sides(m: int, n: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    return tuple(range(m)), tuple(range(m, m + n))


@dataclass(frozen=True)
class Points:
    """Dense numbers of the vertices and possible crossings of a graph."""

    vertices: tuple[int, ...]
    edges: tuple[Edge, ...]

    @cached_property
    def crossings(self) -> tuple[Crossing, ...]:
        return tuple(sorted(crossing(e, f) for e, f in combinations(self.edges, 2) if not {*e} & {*f}))

    @cached_property
    def crossing_id(self) -> dict[Crossing, int]:
        return {c: len(self.vertices) + i for i, c in enumerate(self.crossings)}

    @cached_property
    def edge_id(self) -> dict[Edge, int]:
        return {e: i for i, e in enumerate(self.edges)}

    @cached_property
    def meets(self) -> tuple[tuple[int, ...], ...]:
        """For edges i, j: the number of their crossing, -1 if they share an end."""
        return tuple(tuple(-1 if {*e} & {*f} else self.crossing_id[crossing(e, f)] for f in self.edges) for e in self.edges)

    @cached_property
    def parts(self) -> dict[int, tuple[int, int]]:
        """A crossing's two edge numbers, the larger edge first."""
        return {p: (self.edge_id[e], self.edge_id[f]) for (e, f), p in self.crossing_id.items()}

    def relabeling(self, image: dict[int, int]) -> tuple[int, ...]:
        """Where each point goes if vertices go to their image."""
        move = lambda e: edge(image[e[0]], image[e[1]])
        return (*(image[v] for v in self.vertices), *(self.crossing_id[crossing(move(e), move(f))] for e, f in self.crossings))


@dataclass(frozen=True)
class Step:
    """An edge that is drawn; from names the end that is drawn from, fresh whether it is new."""

    edge: Edge
    start: int
    target: int
    fresh: bool


@dataclass(frozen=True)
class Stage:
    """A vertex with its edges, or the edges that are left over."""

    kind: str
    vertex: int | None
    steps: tuple[Step, ...]


def normalize_graph(edges: Iterable[Edge]) -> tuple[tuple[int, ...], tuple[Edge, ...]]:
    """Vertices and edges, sorted and distinct."""
    edges = tuple(sorted({edge(*e) for e in edges}))
    return tuple(sorted({v for e in edges for v in e})), edges


def neighbours(edges: Iterable[Edge]) -> dict[int, set[int]]:
    near: dict[int, set[int]] = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    return near


def require_connected(vertices: Sequence[int], edges: Iterable[Edge]) -> None:
    """Raise unless merging the ends of edges leaves one set of vertices."""
    parts = {v: {v} for v in vertices}
    for u, v in edges:
        if parts[u] is not parts[v]:
            whole = parts[u] | parts[v]
            parts |= dict.fromkeys(whole, whole)
    if len({id(p) for p in parts.values()}) != 1:
        raise ValueError("the graph is not connected" if parts else "the graph is empty")


def base_cycle(vertices: Sequence[int], edges: Iterable[Edge]) -> tuple[int, int, int, int]:
    """The first 4-cycle in lexicographic order: opposite vertices have two common neighbours."""
    near = neighbours(edges)
    found = ((a, b, c, d) for a in sorted(vertices) for b in sorted(near[a]) for c in sorted(near[b] - {a}) for d in sorted(near[a] & near[c] - {b}))
    for cycle in found:
        return cycle
    raise ValueError("the graph has no 4-cycle")


def build_stages(edges: Iterable[Edge]) -> tuple[tuple[int, int, int, int], tuple[Stage, ...]]:
    """The base cycle, and the stages: the lowest vertex next to what is drawn, with its edges to drawn vertices, in order."""
    vertices, edges = normalize_graph(edges)
    require_connected(vertices, edges)
    cycle = base_cycle(vertices, edges)
    drawn, left = set(cycle), set(edges) - {edge(cycle[i], cycle[(i + 1) % 4]) for i in range(4)}
    stages: list[Stage] = []
    while len(drawn) < len(vertices):
        vertex = min(v for v in vertices if v not in drawn and any(edge(v, u) in left for u in drawn))
        ends = sorted(u for u in drawn if edge(u, vertex) in left)
        stages.append(Stage("vertex", vertex, tuple(Step(edge(vertex, u), vertex, u, i == 0) for i, u in enumerate(ends))))
        left -= {edge(vertex, u) for u in ends}
        drawn.add(vertex)
    if left:
        stages.append(Stage("edge_completion", None, tuple(Step(e, min(e), max(e), False) for e in sorted(left))))
    return cycle, tuple(stages)


def automorphisms(vertices: Sequence[int], edges: Iterable[Edge]) -> tuple[tuple[int, ...], ...]:
    """All images of the vertices (in order) that keep the edges, sorted; partial images are extended one vertex at a time."""
    near = neighbours(edges)
    found: list[tuple[int, ...]] = [()]
    for i, v in enumerate(vertices):
        found = [
            (*p, w)
            for p in found
            for w in vertices
            if w not in p and len(near[w]) == len(near[v]) and all((vertices[k] in near[v]) == (p[k] in near[w]) for k in range(i))
        ]
    return tuple(sorted(found))


@dataclass(frozen=True)
class Census:
    """Everything static about the census of K(m,n)."""

    m: int
    n: int
    points: Points = field(init=False)
    cycle: tuple[int, int, int, int] = field(init=False)
    stages: tuple[Stage, ...] = field(init=False)

    def __post_init__(self):
        vertices, edges, _ = complete_bipartite(self.m, self.n)
        cycle, stages = build_stages(edges)
        object.__setattr__(self, "points", Points(vertices, tuple(edge(*e) for e in edges)))
        object.__setattr__(self, "cycle", cycle)
        object.__setattr__(self, "stages", stages)

    @property
    def colors(self) -> tuple[int, ...]:
        return (1,) * self.m + (2,) * self.n

    @cached_property
    def group(self) -> tuple[tuple[int, ...], ...]:
        return automorphisms(self.points.vertices, self.points.edges)

    @cached_property
    def cycle_edges(self) -> tuple[Edge, ...]:
        return tuple(edge(self.cycle[i], self.cycle[(i + 1) % 4]) for i in range(4))

    def stage_edges(self, stage: int) -> tuple[Edge, ...]:
        """Edges drawn after stages 0..stage; -1: the base cycle."""
        return tuple(sorted({*self.cycle_edges, *(s.edge for x in self.stages[: stage + 1] for s in x.steps)}))

    def stage_group(self, stage: int) -> tuple[tuple[int, ...], ...]:
        """Automorphisms of the whole graph that keep the stage's edges, one for each action on its vertices, as point relabelings."""
        held = frozenset(self.stage_edges(stage))
        built = sorted(neighbours(held))
        first: dict[tuple[int, ...], tuple[int, ...]] = {}
        for p in reversed(self.group):  # of those that act alike the least is put last and stays
            if held == {edge(p[u], p[v]) for u, v in held}:
                first[tuple(p[v] for v in built)] = p
        return tuple(self.points.relabeling(dict(enumerate(first[action]))) for action in sorted(first))

    def color_group(self, blind: bool) -> tuple[tuple[int, ...], ...]:
        """Vertex images that keep the colors, with blind also those that exchange them."""
        return tuple(p for p in self.group if blind or all((v < self.m) == (w < self.m) for v, w in enumerate(p)))

"""Good drawings on dense point numbers: normal form, seeds, and the extension by an edge.

A drawing has a path for each edge drawn so far (points from the larger end to the smaller) and a set of faces, each the
largest of its cycle's rotations in either direction, without the first point repeated. Catalyst has no operator for the
stateful splitting of faces, so this part is plain Python that runs inside an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

from planarflow.plans.graph import Census, Points, Stage, Step

Cycle = tuple[int, ...]


def canonical_cycle(cycle: Cycle) -> Cycle:
    """The largest rotation over both directions of an open cycle; a repeated end is dropped."""
    if len(cycle) > 1 and cycle[0] == cycle[-1]:
        cycle = cycle[:-1]
    if len(cycle) < 2:
        return tuple(cycle)
    top, n = max(cycle), len(cycle)
    best: Cycle = ()
    for way in (tuple(cycle), tuple(cycle)[::-1]):
        twice = way + way
        for i in range(n):
            if way[i] == top and twice[i : i + n] > best:
                best = twice[i : i + n]
    return best


@dataclass(frozen=True)
class Drawing:
    """Paths by edge number, and faces."""

    paths: tuple[tuple[int, tuple[int, ...]], ...]
    faces: frozenset[Cycle]

    def crossings(self, vertices: int) -> tuple[int, ...]:
        return tuple(sorted({p for _, path in self.paths for p in path[1:-1] if p >= vertices}))

    def arcs(self) -> tuple[tuple[int, int], ...]:
        return tuple(sorted({arc(u, v) for _, path in self.paths for u, v in zip(path, path[1:])}))


def arc(u: int, v: int) -> tuple[int, int]:
    return (u, v) if u > v else (v, u)


def normal(paths: dict[int, tuple[int, ...]], faces) -> Drawing:
    """The normal form: paths by edge, from their larger end; faces canonical and distinct."""
    straight = ((e, p if p[0] > p[-1] else p[::-1]) for e, p in paths.items())
    return Drawing(tuple(sorted(straight)), frozenset(canonical_cycle(f) for f in faces))


def check(drawing: Drawing, points: Points) -> None:
    """Raise if a path does not run between its edge's ends over crossings of that edge, or a face is empty."""
    for e, path in drawing.paths:
        if (path[0], path[-1]) != points.edges[e]:
            raise ValueError(f"path {path} does not join the ends of edge {points.edges[e]}")
        if any(p < len(points.vertices) or e not in points.parts[p] for p in path[1:-1]) or len({*path}) < len(path):
            raise ValueError(f"path {path} has points that are no crossings of its edge")
    if any(not f for f in drawing.faces):
        raise ValueError("empty face")


def seeds(census: Census) -> tuple[Drawing, Drawing]:
    """The two drawings of the base cycle: without a crossing (its two faces coincide), and with one."""
    p0, p1, p2, p3 = census.cycle
    points = census.points
    flat = {points.edge_id[e]: e for e in census.cycle_edges}
    e, f = census.cycle_edges[0], census.cycle_edges[2]
    x = points.meets[points.edge_id[e]][points.edge_id[f]]
    crossed = flat | {points.edge_id[g]: (g[0], x, g[1]) for g in (e, f)}
    # p0-p1 crosses p2-p3, while p1-p2 and p3-p0 are free.
    return normal(flat, [(p0, p1, p2, p3)]), normal(crossed, [(x, p1, p2), (x, p3, p0), (x, p1, p2, x, p0, p3)])


def relabel(drawing: Drawing, points: Points, move: tuple[int, ...]) -> Drawing:
    """The drawing with points moved."""
    n = len(points.vertices)
    out = {}
    for e, path in drawing.paths:
        u, v = points.edges[e]
        a, b = move[u], move[v]
        out[points.edge_id[(a, b) if a > b else (b, a)]] = tuple(move[p] for p in path)
    assert all(p < n for path in out.values() for p in (path[0], path[-1]))
    return normal(out, [tuple(move[p] for p in f) for f in drawing.faces])


def splits(cycle: Cycle, start: int, end: int) -> Iterator[tuple[Cycle, Cycle]]:
    """All ways to cut an open cycle by a chord between an occurrence of start and one of end."""
    n = len(cycle)
    for i in range(n):
        if cycle[i] == start:
            way = cycle[i:] + cycle[:i]
            for j in range(n):
                if way[j] == end:
                    yield way[: j + 1], way[j:] + way[:1]


class Extender:
    """All ways to draw one step into a drawing."""

    def __init__(self, points: Points, drawing: Drawing, step: Step):
        self.points, self.drawing, self.step = points, drawing, step
        self.edge = points.edge_id[step.edge]
        self.faces = tuple(sorted(drawing.faces))
        owner = {arc(u, v): e for e, path in drawing.paths for u, v in zip(path, path[1:])}
        self.owner = owner
        beside: dict[tuple[int, int], list[int]] = {}
        border = [[arc(u, v) for u, v in zip(f, f[1:] + f[:1])] if len(f) > 1 else [] for f in self.faces]
        for i, arcs in enumerate(border):
            for a in arcs:
                beside.setdefault(a, []).append(i)
        self.doors: list[list[tuple[int, tuple[int, int], int]]] = []
        for i, arcs in enumerate(border):
            out = []
            for a in arcs:
                x = points.meets[self.edge][owner[a]] if a in owner else -1
                far = next((j for j in beside[a] if j != i), None)
                if x >= 0 and far is not None:
                    out.append((x, a, far))
            self.doors.append(out)

    def routes(self) -> Iterator[tuple[tuple[int, ...], tuple[tuple[int, tuple[int, int]], ...]]]:
        """Faces in order, and the crossing and arc between each two: no edge is crossed twice; a route that has arrived goes on too."""
        s = self.step
        goal = [s.target in f for f in self.faces]
        todo = [((i,), (), 0) for i, f in enumerate(self.faces) if s.fresh or s.start in f]
        while todo:
            faces, passed, used = todo.pop()
            if goal[faces[-1]]:
                yield faces, passed
            for x, a, far in self.doors[faces[-1]]:
                bit = 1 << x
                if not used & bit:
                    todo.append(((*faces, far), (*passed, (x, a)), used | bit))

    def _with(self, face: Cycle, inserted: dict[tuple[int, int], int]) -> Cycle:
        out = []
        for u, v in zip(face, face[1:] + face[:1]):
            out.append(u)
            if (x := inserted.get(arc(u, v))) is not None and len(face) > 1:
                out.append(x)
        return tuple(out)

    def face_choices(self, faces: tuple[int, ...], passed) -> dict[int, list[list[Cycle]]] | None:
        """For each face of a route the lists of faces it can fall apart into; None if some visit finds no way."""
        s = self.step
        inserted = {a: x for x, a in passed}
        choices = {i: [[self._with(self.faces[i], inserted)]] for i in {*faces}}
        stops = [s.start, *(x for x, _ in passed), s.target]
        for k, i in enumerate(faces):
            enter, leave = stops[k], stops[k + 1]
            kept: list[list[Cycle]] = []
            for parts in choices[i]:
                if k == 0 and s.fresh:
                    (whole,) = parts
                    for j, p in enumerate(whole):
                        if p == leave:  # the new vertex hangs at this occurrence
                            kept.append([(*whole[: j + 1], s.start, *whole[j:])])
                    continue
                at = 0 if k == 0 else next((c for c, cycle in enumerate(parts) if enter in cycle and leave in cycle), None)
                if at is not None:
                    kept += [[*parts[:at], a, b, *parts[at + 1 :]] for a, b in splits(parts[at], enter, leave)]
            if not kept:
                return None
            choices[i] = kept
        return choices

    def crossing_sets(self) -> Iterator[frozenset[int]]:
        """New crossings of each feasible route, without building drawings."""
        for faces, passed in self.routes():
            if self.face_choices(faces, passed) is not None:
                yield frozenset(x for x, _ in passed)

    def drawings(self) -> Iterator[Drawing]:
        s = self.step
        old = dict(self.drawing.paths)
        for faces, passed in self.routes():
            choices = self.face_choices(faces, passed)
            if choices is None:
                continue
            paths = dict(old)
            inserted = {a: x for x, a in passed}
            for _, a in passed:
                path = paths[self.owner[a]]
                out = [path[0]]
                for u, v in zip(path, path[1:]):
                    if (x := inserted.get(arc(u, v))) is not None:
                        out.append(x)
                    out.append(v)
                paths[self.owner[a]] = tuple(out)
            paths[self.edge] = (s.start, *(x for x, _ in passed), s.target)
            rest = [f for i, f in enumerate(self.faces) if i not in choices]
            for pick in product(*choices.values()):
                yield normal(paths, [*rest, *(cycle for parts in pick for cycle in parts)])


def extend_step(points: Points, drawing: Drawing, step: Step) -> Iterator[Drawing]:
    return Extender(points, drawing, step).drawings()


def extend_stage(points: Points, drawing: Drawing, stage: Stage) -> Iterator[Drawing]:
    """All drawings after a stage's steps, depth first; at each depth a drawing is followed once."""
    seen: list[set[Drawing]] = [set() for _ in stage.steps]
    todo = [(drawing, 0)]
    while todo:
        d, depth = todo.pop()
        if depth == len(stage.steps):
            yield d
            continue
        for child in extend_step(points, d, stage.steps[depth]):
            if child not in seen[depth]:
                seen[depth].add(child)
                todo.append((child, depth + 1))


def stage_crossings(points: Points, drawing: Drawing, stage: Stage) -> set[frozenset[int]]:
    """Distinct crossing sets after a stage; the last step builds no drawings."""
    held = {drawing}
    for step in stage.steps[:-1]:
        held = {c for d in held for c in extend_step(points, d, step)}
    n = len(points.vertices)
    return {frozenset(d.crossings(n)) | new for d in held for new in Extender(points, d, stage.steps[-1]).crossing_sets()}

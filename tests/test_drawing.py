from itertools import product

import pytest

from planarflow.functions import canonical
from planarflow.functions.drawing import Drawing, Extender, arc, canonical_cycle, check, extend_stage, extend_step, relabel, seeds, splits, stage_crossings
from planarflow.plans.graph import Census, Step


def slow_cycle(cycle):
    n = len(cycle)
    return max((w[i:] + w[:i] for w in (cycle, cycle[::-1]) for i in range(n)), default=())


def test_cycles_by_exhaustion():
    for cycle in product(range(3), repeat=4):
        if cycle[0] != cycle[-1]:
            assert canonical_cycle(cycle) == slow_cycle(cycle) == canonical_cycle((*cycle, cycle[0]))
    assert canonical_cycle(()) == () and canonical_cycle((0,)) == (0,) and canonical_cycle((2, 0, 2, 1)) == (2, 1, 2, 0)
    assert canonical_cycle((3, 1, 2, 0, 3)) == (3, 1, 2, 0)


def test_seeds():
    c = Census(2, 2)
    flat, crossed = seeds(c)
    assert flat.faces == {(3, 1, 2, 0)} and not flat.crossings(4)
    x = c.points.crossing_id[((3, 1), (2, 0))]
    assert crossed.faces == {canonical_cycle((x, 2, 1)), canonical_cycle((x, 3, 0)), canonical_cycle((x, 3, 0, x, 1, 2))}
    for d in (flat, crossed):
        check(d, c.points)
    with pytest.raises(ValueError):
        check(Drawing(((0, (2, 1)),), frozenset()), c.points)


def test_splits():
    assert list(splits((0, 1, 2, 3), 1, 3)) == [((1, 2, 3), (3, 0, 1))]
    assert len(list(splits((0, 1, 0, 2), 0, 2))) == 2


def test_pendant_child_of_the_planar_seed():
    c = Census(2, 3)
    (child,) = extend_step(c.points, seeds(c)[0], c.stages[0].steps[0])
    assert not child.crossings(5) and len(child.faces) == 1
    closing = Extender(c.points, child, c.stages[0].steps[1])
    assert len(list(closing.routes())) == 1 and len(list(closing.drawings())) == 1


def test_an_end_that_occurs_twice_on_a_face_gives_two_drawings():
    c = Census(2, 4)
    (child,) = extend_step(c.points, seeds(c)[0], Step((4, 0), 4, 0, True))
    x = Extender(c.points, child, Step((5, 0), 5, 0, True))
    assert len(list(x.routes())) == 1 and len(list(x.drawings())) == 2 and len(list(x.crossing_sets())) == 1


def test_routes_that_no_face_choice_allows():
    c = Census(3, 3)
    odd = 0
    for d in (e for s in seeds(c) for e in extend_stage(c.points, s, c.stages[0])):
        x = Extender(c.points, d, c.stages[1].steps[0])
        again = [r for r in x.routes() if len({*r[0]}) < len(r[0])]
        odd += sum(x.face_choices(*r) is None for r in again)
    assert odd > 0


def slow_routes(x: Extender):
    """Routes with lists in place of bits."""
    out = []

    def go(faces, passed):
        if x.step.target in x.faces[faces[-1]]:
            out.append((tuple(faces), tuple(passed)))
        for p, a, far in x.doors[faces[-1]]:
            if p not in [q for q, _ in passed]:
                go([*faces, far], [*passed, (p, a)])

    for i, f in enumerate(x.faces):
        if x.step.fresh or x.step.start in f:
            go([i], [])
    return out


@pytest.mark.parametrize("m,n", [(2, 3), (3, 3)])
def test_routes_equal_a_plain_search(m, n):
    c = Census(m, n)
    parents = [d for s in seeds(c) for d in extend_step(c.points, s, c.stages[0].steps[0])]
    for d in parents:
        x = Extender(c.points, d, c.stages[0].steps[1])
        assert sorted(x.routes()) == sorted(slow_routes(x))
        assert {frozenset(e.crossings(m + n)) - frozenset(d.crossings(m + n)) for e in x.drawings()} == set(x.crossing_sets())


def breadth_first(c, d, stage):
    held = {d}
    for step in stage.steps:
        held = {e for x in held for e in extend_step(c.points, x, step)}
    return held


@pytest.mark.parametrize("m,n", [(2, 3), (3, 3)])
def test_depth_first_equals_breadth_first(m, n):
    c = Census(m, n)
    for d in seeds(c):
        assert set(extend_stage(c.points, d, c.stages[0])) == breadth_first(c, d, c.stages[0])
        assert stage_crossings(c.points, d, c.stages[0]) == {frozenset(e.crossings(m + n)) for e in extend_stage(c.points, d, c.stages[0])}


def test_forms_do_not_depend_on_labels():
    c = Census(3, 3)
    can = canonical.canonizer(3, 3, 0)
    for s in seeds(c):
        for d in extend_stage(c.points, s, c.stages[0]):
            form = can.form(d)
            assert canonical.unpack(form) == relabel(canonical.unpack(form), c.points, tuple(range(6 + 18)))
            for move in c.stage_group(0):
                moved = relabel(d, c.points, move)
                check(moved, c.points)
                assert can.form(moved) == form and can.form(moved, faces=False) == can.form(d, faces=False)


def test_every_edge_crosses_another_once():
    c = Census(2, 4)
    for s in seeds(c):
        for d in extend_stage(c.points, s, c.stages[0]):
            owners = {}
            for e, path in d.paths:
                assert len({*path}) == len(path)
                for u, v in zip(path, path[1:]):
                    owners.setdefault(arc(u, v), set()).add(e)
            assert all(len(v) == 1 for v in owners.values())


def test_invariants_and_sides():
    c = Census(3, 3)
    d = next(e for s in seeds(c)[1:] for e in extend_stage(c.points, s, c.stages[0]))
    assert canonical.invariant(d, "path-crossing-counts", c.points) == canonical.path_crossing_counts(d)
    assert canonical.invariant(d, "min-path-length", c.points) == min(canonical.path_lengths(d))
    assert canonical.invariant(d, "face-length-distinct-count", c.points) == len(set(canonical.face_lengths(d)))
    assert len(canonical.invariant(d, "crossing-endpoint-degrees", c.points)) == canonical.invariant(d, "crossing-count", c.points)
    with pytest.raises(ValueError):
        canonical.invariant(d, "color", c.points)
    square = Census(2, 2)
    assert [canonical.side_swap(x, square) for x in seeds(square)] == [(True, True)] * 2
    assert canonical.side_swap(d, Census(3, 4)) == (False, False)
    assert Step((4, 0), 4, 0, True).fresh

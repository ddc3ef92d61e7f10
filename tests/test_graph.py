import pytest

from planarflow.plans.graph import Census, Points, automorphisms, build_stages, complete_bipartite, crossing, base_cycle, edge, normalize_graph, require_connected, sides


def test_layout():
    vertices, edges, colors = complete_bipartite(3, 4)
    assert vertices == tuple(range(7)) and len(edges) == 12 and colors == (1, 1, 1, 2, 2, 2, 2)
    assert sides(2, 3) == ((0, 1), (2, 3, 4))
    with pytest.raises(ValueError):
        complete_bipartite(1, 3)


@pytest.mark.parametrize("m,n,count", [(5, 4, 120), (6, 3, 90), (4, 4, 72), (3, 5, 60), (2, 3, 6)])
def test_possible_crossings(m, n, count):
    points = Points(tuple(range(m + n)), tuple(edge(*e) for e in complete_bipartite(m, n)[1]))
    assert len(points.crossings) == count and list(points.crossings) == sorted(points.crossings)
    assert len({frozenset((*e, *f)) for e, f in points.crossings}) == count // 2


def test_normal_edges_and_crossings():
    assert edge(1, 3) == (3, 1) and crossing((0, 2), (1, 3)) == ((3, 1), (2, 0))
    with pytest.raises(ValueError):
        edge(2, 2)
    with pytest.raises(ValueError):
        crossing((0, 2), (2, 1))


@pytest.mark.parametrize("m,n,stages,steps,group", [(2, 3, [4], [2], 12), (2, 6, [4, 5, 6, 7], [2] * 4, 1440), (3, 3, [2, 5], [2, 3], 72), (3, 4, [2, 5, 6], [2, 3, 3], 144), (4, 4, [2, 3, 6, 7], [2, 2, 4, 4], 1152)])
def test_plan(m, n, stages, steps, group):
    c = Census(m, n)
    assert c.cycle == (0, m, 1, m + 1)
    assert [s.vertex for s in c.stages] == stages and [len(s.steps) for s in c.stages] == steps
    assert len(c.group) == group and len(c.stage_group(len(stages) - 1)) == group
    assert len(c.stage_group(0)) < group or len(stages) == 1


def test_other_graphs():
    cycle, stages = build_stages([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)])
    assert cycle == (0, 1, 2, 3) and [s.kind for s in stages] == ["edge_completion"]
    with pytest.raises(ValueError):
        require_connected((0, 1, 2), [(0, 1)])
    with pytest.raises(ValueError):
        build_stages([(0, 1), (1, 2)])
    assert normalize_graph([(1, 0), (0, 1)]) == ((0, 1), ((1, 0),))


def test_symmetries():
    square = [(0, 1), (1, 2), (2, 3), (3, 0)]
    group = automorphisms(range(4), square)
    assert len(group) == 8 and all({edge(p[u], p[v]) for u, v in square} == {edge(*e) for e in square} for p in group)
    assert sum(p == tuple(range(4)) for p in group) == 1


def test_base_cycle_is_the_first_one():
    from itertools import combinations, permutations

    import random

    r = random.Random(5)
    for _ in range(60):
        n = r.randrange(4, 8)
        edges = [e for e in combinations(range(n), 2) if r.random() < 0.5]
        held = {edge(*e) for e in edges}
        want = next((p for p in permutations(range(n), 4) if all(edge(p[i], p[(i + 1) % 4]) in held for i in range(4))), None)
        if want:
            assert base_cycle(range(n), edges) == want
        else:
            with pytest.raises(ValueError):
                base_cycle(range(n), edges)

import itertools
import random

from planarflow.operators import labelling
from planarflow.operators.labelling import graph_forms


def forms(spark, graphs):
    """graphs: {name: (colours by vertex, edges)}"""
    v = [(g, x, c) for g, (colours, _) in graphs.items() for x, c in colours.items()]
    e = [(g, a, b) for g, (_, edges) in graphs.items() for a, b in edges]
    found = graph_forms(spark.createDataFrame(v, "graph long, vertex long, colour string").repartition(3), spark.createDataFrame(e, "graph long, u long, v long").repartition(3))
    return {r.graph: r.form for r in found.collect()}


def brute(colours, edges):
    names = sorted(colours)
    best = None
    for p in itertools.permutations(range(len(names))):
        at = dict(zip(names, p))
        form = (sorted((at[x], c or "") for x, c in colours.items()), sorted({tuple(sorted((at[a], at[b]))) for a, b in edges if a != b}))
        best = form if best is None or form < best else best
    return str(best)


def classes(forms):
    out = {}
    for g, f in forms.items():
        out.setdefault(f, set()).add(g)
    return sorted(map(sorted, out.values()))


def moved(colours, edges, seed):
    r = random.Random(seed)
    names = r.sample(range(1000), len(colours))
    at = dict(zip(colours, names))
    edges = [(at[b], at[a]) if r.random() < 0.5 else (at[a], at[b]) for a, b in edges]
    r.shuffle(edges)
    return {at[x]: c for x, c in colours.items()}, edges


def test_classes_of_random_graphs_equal_brute_force(spark):
    r = random.Random(1)
    graphs = {}
    for g in range(70):
        n = r.randrange(1, 6)
        graphs[g] = ({x: r.choice(["red", "red", None]) for x in range(n)}, [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(8))])
    assert classes(forms(spark, graphs)) == classes({g: brute(*x) for g, x in graphs.items()})


def test_symmetric_graphs(spark):
    """Graphs that refinement alone does not tell apart, in several orders: two triangles and a hexagon; prism and K(3,3); star, cube, Petersen graph."""
    ring = lambda n, at=0: [(at + i, at + (i + 1) % n) for i in range(n)]
    shapes = [
        (6, ring(3) + ring(3, 3)),
        (6, ring(6)),
        (6, ring(3) + ring(3, 3) + [(i, i + 3) for i in range(3)]),
        (6, [(a, b) for a in range(3) for b in range(3, 6)]),
        (12, [(0, i) for i in range(1, 12)]),
        (8, [(a, a ^ (1 << k)) for a in range(8) for k in range(3) if a < a ^ (1 << k)]),
        (10, ring(5) + [(5 + i, 5 + (i + 2) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)]),
        (10, [*ring(10), *((i, (i + 5) % 10) for i in range(5))]),
        (24, [(3 * k + i, 3 * k + i + 1) for k in range(8) for i in range(2)]),
        (0, []),
    ]
    graphs, want = {}, []
    for k, (n, edges) in enumerate(shapes[:-1]):
        for j in range(3):
            graphs[10 * k + j] = moved(dict.fromkeys(range(n), "x"), edges, 100 * k + j)
        want.append([10 * k + j for j in range(3)])
    assert classes(forms(spark, graphs)) == sorted(want)


def test_ends_without_a_vertex_row_and_no_graphs(spark):
    v = spark.createDataFrame([(1, 5, "a")], "graph long, vertex long, colour string")
    e = spark.createDataFrame([(2, 1, 2), (3, 9, 8), (3, 8, 9)], "graph long, u long, v long")
    found = {r.graph: r.form for r in graph_forms(v, e).collect()}
    assert found[2] == found[3] != found[1] and len(found) == 3
    assert graph_forms(v.where("false"), e.where("false")).count() == 0


def test_leaves_are_settled_before_any_round(spark, monkeypatch):
    """Stars, pairs and single vertices take part in no round; the classes are those of brute force."""
    rows = []
    plain = labelling._refined
    monkeypatch.setattr(labelling, "_refined", lambda x, lines: rows.append(x.count()) or plain(x, lines))
    r = random.Random(4)
    graphs = {}
    for g in range(60):
        n = r.randrange(1, 7)
        centres = [0] if g % 2 else [0, 1]
        graphs[g] = ({x: r.choice(["red", "blue", None]) for x in range(n)}, [(x, r.choice(centres)) for x in range(len(centres), n) if r.random() < 0.8])
    assert classes(forms(spark, graphs)) == classes({g: brute(*x) for g, x in graphs.items()})
    assert not rows
    # A triangle with a leaf at one corner or two: only the corners are left.
    tri = [(0, 1), (1, 2), (2, 0)]
    some = {0: (dict.fromkeys(range(5), "x"), [*tri, (3, 0), (4, 0)]), 1: (dict.fromkeys(range(5), "x"), [*tri, (3, 0), (4, 1)]), 2: (dict.fromkeys(range(5), "x"), [*tri, (3, 2), (4, 2)])}
    assert classes(forms(spark, some)) == [[0, 2], [1]] and rows[0] == 9

import random

from planarflow.llm.components import components


def test_classes_of_random_edges(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    linked = {x for u, v in edges if u != v for x in (u, v)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0

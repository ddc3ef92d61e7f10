import itertools
import random

import pytest
from pyspark.sql import functions as F

from planarflow.operators import digests, graphs, ties


def random_edges(seed, n, m, hub=False):
    r = random.Random(seed)
    out = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    return out + ([(0, i) for i in range(1, n)] + [(n - 1, i) for i in range(n)] if hub else [])


def adjacency(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long").repartition(3)


def reach(near, roots):
    depth, layer = dict.fromkeys(roots, 0), list(roots)
    while layer:
        layer = sorted({b for a in layer for b in near.get(a, ()) if b not in depth})
        depth |= dict.fromkeys(layer, max(depth.values()) + 1)
    return depth


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 60, 40), (2, 60, 70), (3, 5, 3)])
def test_components_and_distances(spark, seed, n, m):
    edges = random_edges(seed, n, m) + [(200 + i, 201 + i) for i in range(20)] + [(7, 7)]  # a long path, a loop
    near = adjacency(edges)
    want = {v: min(reach(near, [v])) for v in near}
    found = graphs.components(frame(spark, edges))
    assert {r.vertex: r.component for r in found.collect()} == want and found.count() == len(want)
    roots = [min(near), 215, 9999]
    depth = reach(near, roots)
    got = graphs.distances(frame(spark, edges), spark.createDataFrame([(r,) for r in roots], "vertex long")).collect()
    assert {r.vertex: r.depth for r in got} == depth and len(got) == len(depth)
    assert all(r.parent == (min(a for a in near[r.vertex] if depth.get(a) == r.depth - 1) if r.depth else None) for r in got)


def test_edges_shrink_from_round_to_round(spark, monkeypatch):
    sizes, plain = [], graphs.written

    def noted(df, label):
        out = plain(df, label)
        if label == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graphs, "written", noted)
    edges = random_edges(6, 80, 400) + [(900 - i, 901 - i) for i in range(30)] + [(300 + i, 400) for i in range(20)]  # a path, a star with a greater centre
    near = adjacency(edges)
    whole = plain(graphs.undirected(frame(spark, edges)), "whole")
    found = {r.vertex: r.component for r in graphs.components(whole, simple=True).collect()}
    assert found == {v: min(reach(near, [v])) for v in near}
    assert sizes[-1] == 0 and all(b < a / 2 for a, b in zip([whole.count(), *sizes], sizes))


def test_connected(spark):
    assert graphs.connected(frame(spark, [(1, 2), (2, 3)])) and not graphs.connected(frame(spark, [(1, 2), (3, 4)])) and graphs.connected(frame(spark, [(1, 1)]))


@pytest.mark.parametrize(("seed", "n", "m", "hub", "limit"), [(1, 12, 30, False, 10_000), (2, 20, 40, True, 3), (3, 9, 60, False, 2), (4, 30, 25, False, 10_000), (5, 4, 0, False, 5)])
def test_four_cycles(spark, seed, n, m, hub, limit):
    edges = random_edges(seed, n, m, hub)
    near = adjacency(edges)
    pairs = {(x, y): sorted(near[x] & near[y]) for x in near for y in near if x != y and len(near[x] & near[y]) > 1}
    first = min(pairs, default=None)
    got = graphs.four_cycles(frame(spark, edges), limit).collect()
    assert [tuple(r) for r in got] == [(sum(len(c) * (len(c) - 1) // 2 for c in pairs.values()) // 4, *((*first, *pairs[first][:2]) if first else (None,) * 4))]


def test_wedges_are_dealt_to_tasks_of_bounded_work(spark, monkeypatch):
    """K(20,30): 5,700 wedges, four tasks by the session's setting, more by the work; hubs as v and as middle."""
    edges = frame(spark, [(a, 100 + b) for a in range(20) for b in range(30)])
    monkeypatch.setattr(graphs, "WEDGES", 1_000, raising=False)
    for hub in (10_000, 7):
        pairs = graphs.opposite_pairs(edges, hub)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            assert pairs.rdd.getNumPartitions() >= 8
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        got = [(min(r.v, r.w), max(r.v, r.w), r.paths) for r in pairs.collect()]
        assert len(got) == len(set(got)) and sum(n * (n - 1) // 2 for *_, n in got) == 190 * 435


def test_digests_keep_colliding_payloads_apart(spark):
    rows = [None, "", *(f"p{i % 70}" for i in range(400)), *["hot"] * 300]
    df = spark.createDataFrame([(r,) for r in rows], "text string").repartition(4)
    for digits in (0, 1, 2, 64):
        got = digests.distinct_by_digest(df, "text", digests.short_digest("text", digits)).collect()
        assert sorted(((r.payload, r.n) for r in got), key=str) == sorted(((p, rows.count(p)) for p in set(rows)), key=str)
        by = {}
        for r in got:
            by.setdefault(r.digest, []).append(r)
        assert all(r.collided == (len(mine) > 1) for mine in by.values() for r in mine)
    assert digests.distinct_by_digest(df.where("false"), "text", F.lit("x")).count() == 0


def test_best_rows_keep_ties(spark):
    r = random.Random(3)
    rows = [(r.choice([None, "a", "b", "c"]), r.choice([None, 1, 2, 3]), r.randrange(3), r.randrange(2), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, x int, y int, z int, i int").repartition(3)
    got = sorted(ties.best_rows(df, ["k"], [(F.col("x"), "max"), (F.col("y") * 2, "min"), (F.col("z"), "max")]).toPandas()["i"])
    want = []
    for k in {row[0] for row in rows}:
        mine = [row for row in rows if row[0] == k]
        for score in (lambda q: -1 if q[1] is None else q[1], lambda q: -q[2], lambda q: q[3]):
            mine = [q for q in mine if score(q) == max(map(score, mine))]
        want += [q[4] for q in mine]
    assert got == sorted(want)
    with pytest.raises(ValueError):
        ties.best_rows(df, ["k"], [(F.col("x"), "best")])

import numpy as np
import pytest

from planarflow.llm import near_vectors as nv


def brute(rows):
    sound = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    sound = {i: v / abs(v).max() / np.linalg.norm(v / abs(v).max()) for i, v in sound.items()}
    near = {i: [j for j in sound if j != i and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] >= 0.9] if i in sound else [] for i in range(len(rows))}
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    group = {}
    for i, k in enumerate(label):
        group.setdefault(k, []).append(rows[i][0])
    return sorted((rows[i][0], len(near[i]), min(group[label[i]]), rows[i][0] == min(group[label[i]])) for i in range(len(rows)))


def vectors(seed, n=300, d=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n, 3):  # chains of neighbours near the threshold
        x[i] = x[i - 1] + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.3, 0.45])
    return [(int(i), v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(n), x)]


@pytest.mark.parametrize(("block", "cell"), [(20, 30), (64, 100), (16, 400), (4096, 16384)])
def test_links_equal_brute_force(spark, block, cell):
    rows = vectors(block)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in nv.near_duplicates(df, block=block, cell=cell).collect())
    assert got == brute(rows)


def test_dense_groups_are_linked_as_a_whole(spark, monkeypatch):
    """Groups far narrower than a link's reach, next to each other and apart: no pair of their points is compared."""
    rng = np.random.default_rng(4)
    centres = np.array([[1, 0, 0, 0], [0.97, 0.24, 0, 0], [0, 0, 1, 0.0]])
    x = [c + rng.normal(size=4) * 0.004 for c in centres for _ in range(70)] + [rng.normal(size=4) for _ in range(60)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, x[3].tolist()), (901, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = []
    real = nv._near_cells

    def near(levels, reach):
        out = real(levels, reach)
        whole.append(out.where("whole").count())
        return out

    monkeypatch.setattr(nv, "_near_cells", near)
    assert sorted(tuple(r) for r in nv.near_duplicates(df, block=8, cell=10).collect()) == brute(rows)
    assert whole[0] > 3


def test_levels_end_where_cells_cannot_be_split(spark, monkeypatch):
    monkeypatch.setattr(nv, "DEPTH", 1)
    rows = vectors(3, 200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in nv.near_duplicates(df, block=16, cell=20).collect()) == brute(rows)


def test_tiny_and_huge_components(spark):
    rows = [(0, [1e-170, 0.0]), (1, [5e-324, 0.0]), (2, [1e200, 0.0]), (3, [1.7e308, 1e307]), (4, [0.0, -3e-310]), (5, [0.0, -1.0]), (None, [1.0, 0.0]), (None, [-1.0, 0.0]), (None, [-2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nv.near_duplicates(df).collect() if r.vec_id is not None}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (1, 4), 5: (1, 4)}
    nameless = sorted((r.n_links, r.component_id, r.kept) for r in nv.near_duplicates(df).collect() if r.vec_id is None)
    assert nameless[2] == (4, 0, False) and [x[:2] for x in nameless[:2]] == [(1, None)] * 2


def test_unsound_vectors(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [1.0, float("inf")]), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, n_links int")
    got = sorted(tuple(r) for r in nv.near_duplicates(df).collect())
    assert got == brute(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert nv.near_duplicates(df).count() == 0


def test_levels_halve_and_radii_cover():
    x = nv.unit(np.array([v for _, v in vectors(7)]))
    tree = nv.CoverTree(x)
    assert sorted(tree.order) == list(range(len(x)))
    for node, (a, b) in enumerate(tree.range):
        assert nv.gaps(tree.points[a:b], tree.points[tree.centre[node]][None]).max() <= tree.radius[node] + 1e-7
        kids = tree.children(node)
        if kids[0] != node:
            assert tree.centre[kids[0]] == tree.centre[node]
            assert sorted(i for k in kids for i in range(*tree.range[k])) == list(range(a, b))
            assert all(tree.radius[k] <= tree.radius[node] / 2 + 1e-4 or tree.radius[k] < tree.radius[node] for k in kids)
    again = nv.CoverTree.unpack(tree.points, tree.pack())
    one = np.ones(len(x), np.int64)
    links = nv.traverse(again, again, one, one, 0.9, True)
    near = tree.points @ tree.points.T >= 0.9
    assert (links.a + links.b == near.sum(axis=1) - 1).all()


def test_vectors_link_within_their_length(spark):
    from planarflow.llm import near_vectors

    rows = [(i, [1.0, float(i), 0.0]) for i in (0, 10, 11)] + [(20, [1.0, 2.0]), (21, [1.0, 2.0]), (22, [2.0, 4.1]), (30, None)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {0: (0, 0, True), 10: (1, 10, True), 11: (1, 10, False), 20: (2, 20, True), 21: (2, 20, False), 22: (2, 20, False), 30: (0, 30, True)}

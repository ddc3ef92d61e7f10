import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planarflow.llm import centroids as cc


def brute(rows, dims, k, rounds, scale=256):
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and None not in v and np.isfinite(v).all()]
    by = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in by[:k]]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda v: min((gap(v, o), j) for j, o in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    ends = [near(v) for _, v in kept]
    name = [hashlib.sha256(",".join(map(str, o)).encode()).hexdigest() for o in c]
    inertia = {j: sum(d for d, o in ends if o == j) for _, j in ends}
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), name[j]) for (i, _), (d, j) in zip(kept, ends)), key=str)


def vectors(seed, n, d, step=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, d))
    x = middle[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.4
    return [(int(i), np.round(v / step) * step) for i, v in enumerate(x)]


def rows_of(data):
    return [(i, v if v is None else [c if c is None else float(c) for c in v]) for i, v in data]


@pytest.mark.parametrize(("seed", "n", "d", "k", "group", "step"), [(1, 500, 8, 20, 4, 0.001), (2, 400, 3, 15, 15, 1.0), (3, 300, 4, 30, 1, 0.5), (4, 60, 2, 7, 3, 1.0)])
def test_results_equal_full_scans(spark, seed, n, d, k, group, step):
    """With coarse steps there are many equal distances and equal vectors."""
    rows = rows_of(vectors(seed, n, d, step))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((tuple(r) for r in cc.cluster_digests(df, dims=d, clusters=k, group=group).collect()), key=str)
    assert got == brute(rows, d, k, 5)


def test_bounds_spare_distances():
    x = np.array([np.floor(256 * v) for _, v in vectors(5, 2000, 16, 1e-6)], np.int64)
    c = x[:40].copy()
    groups = cc.grouped(c)
    assert sorted(np.concatenate(groups).tolist()) == list(range(40)) and len(groups) > 1
    b, shift, computed = cc.Bounds(x, groups, None, None, None), None, []
    for _ in range(8):
        b.scanned = 0
        b.move(c, shift)
        gaps = cc.squared_gaps(x, c)
        assert (b.cluster == gaps.argmin(1)).all()
        own = np.sqrt(gaps[np.arange(len(x)), b.cluster])
        assert (b.upper >= own * (1 - 1e-12)).all()
        gaps[np.arange(len(x)), b.cluster] = np.iinfo(np.int64).max
        for g, members in enumerate(groups):
            assert (b.lower[:, g] <= np.sqrt(gaps[:, members].min(1)) * (1 + 1e-12)).all()
        computed.append(b.scanned)
        new = np.array([x[b.cluster == j].sum(0) // max(1, (b.cluster == j).sum()) if (b.cluster == j).any() else c[j] for j in range(40)])
        shift = np.sqrt(((new - c) ** 2).sum(1))
        c = new
    assert computed[0] > 2000 * 40 and min(computed[3:]) < computed[0] / 3


def test_awkward_vectors(spark):
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 0.0]), (53, [float("inf"), 0.0, 0.0]), (54, [1.0]), (55, [])]
    sound = [(None, [0.1, 0.2, 0.3]), (None, [0.0, 0.0, 0.0]), (1, [-0.0, -0.001, 1.0]), (1, [-0.0, -0.001, 1.0]), (2, [1e4, -1e4, 0.0]), (3, [4e5, 1.0, -5.0])]
    df = spark.createDataFrame(bad + sound, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("other")).withColumn("v", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    for k in (2, 40):
        got = sorted((tuple(r) for r in cc.cluster_digests(df, dims=3, clusters=k).collect()), key=str)
        assert got == brute(bad + sound, 3, k, 5)
    assert cc.cluster_digests(df.where("vec_id >= 50"), dims=3).count() == 0


def test_exact_in_both_number_types():
    rng = np.random.default_rng(0)
    for most in (1 << 10, 1 << 26):
        x, c = rng.integers(-most, most, (50, 8)), rng.integers(-most, most, (9, 8))
        want = [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x]
        assert cc.squared_gaps(x, c).tolist() == want


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        cc.cluster_digests(df, dims=4).collect()

import os

import pytest
from pyspark.sql import functions as F

from planarflow.operators import ordered

DATA = "/root/testdata/sf0.001"


def table(spark, path, schema):
    return spark.read.schema(schema).parquet(path)


def test_rows_are_unique_in_order_and_numbered(spark, tmp_path):
    rows = [(None if i % 31 == 0 else f"k{i % 5}", (i * 37) % 101) for i in range(900)] + [("hot", 1)] * 3000
    df = spark.createDataFrame(rows, "k string, v long").repartition(6)
    path = str(tmp_path / "t")
    ordered.sort_unique(df, ["k", "v"], path, "k", {"top": F.max("v")}, tasks=5)
    kept = ordered.numbered(table(spark, path, "v long, n long, top long, _at long, k string"))
    got = sorted((tuple(r) for r in kept.select("row", "k", "v", "n", "top").collect()))
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r))
    assert [r[:3] for r in got] == [(i, *r) for i, r in enumerate(order)]
    assert all(r[3] == rows.count(r[1:3]) and r[4] == r[2] for r in got)
    keys = ordered.manifest(kept, "k", F.lit(8))
    placed = sorted((r.row, r.place) for r in ordered.in_key(kept, keys, "k").collect())
    want, at = [], {}
    for i, r in enumerate(order):
        at[r[0]] = at.get(r[0], -1) + 1
        want.append((i, at[r[0]]))
    assert placed == want


def test_places_take_two_reads_of_the_files(spark, tmp_path):
    """A null key, keys over several ranges; the files are listed in one scan of the plan, and in one before it."""
    rows = [(None if i % 31 == 0 else i % 5, (i * 37) % 101) for i in range(900)]
    path = str(tmp_path / "t")
    ordered.sort_unique(spark.createDataFrame(rows, "k long, v long").repartition(6), ["k", "v"], path, "k", tasks=7)
    out = ordered.placed(table(spark, path, "v long, n long, _at long, k long"), "k")
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r))
    at = {}
    want = [(i, *r, at.setdefault(r[0], i)) for i, r in enumerate(order)]
    got = sorted((tuple(r) for r in out.select("row", "k", "v", "place", "records").collect()))
    assert got == [(i, k, v, i - first, sum(r[0] == k for r in order)) for i, k, v, first in want]
    assert out._jdf.queryExecution().simpleString().count(f"file:{path}") == 1


def test_files_hold_their_rows_in_order(spark, tmp_path):
    if not os.path.isdir(DATA):
        pytest.skip("the given tables are not here")
    df = spark.read.parquet(f"{DATA}/lineitem.parquet")
    path = str(tmp_path / "t")
    ordered.sort_unique(df, ["l_suppkey", "l_orderkey"], path, tasks=6)
    sizes = []
    last = None
    for name in sorted(f for f in os.listdir(path) if f.startswith("part-")):
        mine = [(r.l_suppkey, r.l_orderkey) for r in spark.read.parquet(f"{path}/{name}").collect()]
        assert mine == sorted(mine) and (last is None or not mine or last < mine[0])
        last = mine[-1] if mine else last
        sizes.append(len(mine))
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2] and sum(sizes) == df.select("l_suppkey", "l_orderkey").distinct().count()


def test_one_wide_shuffle_and_one_by_range(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    plan = df.groupBy("k", "v").agg(F.count("*")).repartitionByRange(4, "k", "v").sortWithinPartitions("k", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2


@pytest.mark.parametrize("limit", [10, 64, 1000])
def test_shards_stay_under_their_limit(spark, tmp_path, limit):
    sizes = [(i * 7919) % 23 + (200 if i % 97 == 5 else 0) for i in range(700)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k long, s long").repartition(5)
    path = str(tmp_path / "t")
    ordered.sort_unique(df, ["k", "s"], path, tasks=4)
    dealt = ordered.deal_by_bytes(ordered.numbered(table(spark, path, "k long, s long, n long, _at long")), F.col("s"), limit)
    shards = {}
    for r in sorted(dealt.collect(), key=lambda r: r.row):
        shards.setdefault(r.shard, []).append(r)
    assert sum(map(len, shards.values())) == 700
    for mine in shards.values():
        at = 0
        for r in mine:
            assert r.offset == at  # rows follow each other without gaps
            at += r.s
        assert at <= limit or len(mine) == 1
        assert len(mine) == 1 or all(r.s * 2 <= limit for r in mine)
    small = sorted(s for s in shards if s >= 0)
    assert small == list(range(len(small))) or limit < 50


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    ordered.sort_unique(spark.createDataFrame([], "k long"), ["k"], path)
    rows = ordered.numbered(table(spark, path, "k long, n long, _at long"))
    assert rows.count() == ordered.deal_by_bytes(rows, F.lit(1), 10).count() == 0

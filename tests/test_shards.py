import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from planarflow.operators import profile
from planarflow.sources import shards
from planarflow.sources.chunk_source import ChunkSource, file_facts

H = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(60)]


@pytest.mark.parametrize(("kind", "make"), [("raw", lambda i: (H[i], b"p%d" % i)), ("reduced", lambda i: (H[i], H[-i], b"q" * i)), ("flag", lambda i: (H[i], "inv " * (i % 3), f"größe {i}"))])
def test_shards_of_each_kind(spark, tmp_path, kind, make):
    path, rows = str(tmp_path / "s"), [make(i) for i in range(60)]
    columns = shards.KINDS[kind][0]
    types = ", ".join(f"{c} {'binary' if c == 'payload' else 'string'}" for c in columns)
    df = spark.createDataFrame([*rows, (None,) * len(columns)], types)
    shards.write_shards(df.limit(30), path, kind)
    shards.write_shards(df.subtract(df.limit(30)), path, kind)
    plain = lambda x: sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in x.select(*columns).collect())
    got = shards.scan_shards(spark, path, kind)
    assert plain(got) == sorted(rows)
    assert {(r.prefix, r[2][:2]) for r in got.collect()} == {(h[:2], h[:2]) for h in H}
    some = [H[3][:2], H[7][:2]]
    assert plain(shards.scan_shards(spark, path, kind, some)) == sorted(r for r in rows if r[0][:2] in some)
    assert shards.shard_sizes(got).agg(F.sum("records")).first()[0] == 60


def test_lines_in_order_over_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"{i % 7:02x}", f"flag {i}") for i in range(300)]
    shards.write_lines(spark.createDataFrame(rows, "bucket string, flag string").repartition(3), path, ["bucket", "flag"], tasks=4)
    lines = []
    for name in sorted(f for f in os.listdir(path) if f.startswith("part-")):
        assert name.endswith(".gz")
        lines += gzip.open(f"{path}/{name}", "rt").read().splitlines()
    assert lines == ["\t".join(r) for r in sorted(rows)]


@pytest.mark.parametrize("chunk", [1, 7, 64, 5000])
def test_files_are_digested_in_chunks(spark, tmp_path, chunk):
    spark.dataSource.register(ChunkSource)
    data = {"a.txt": b"one\ntwo\nthree", "b/c.txt": b"x" * 333 + b"\n", "empty": b"", "d": b"\n" * 20, "_hidden": b"no", ".dot": b"no"}
    for name, held in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(held)
    got = {os.path.relpath(r.file, tmp_path): r for r in file_facts(spark.read.format("chunks").option("chunkBytes", chunk).load(str(tmp_path))).collect()}
    assert set(got) == {"a.txt", "b/c.txt", "empty", "d"}
    for name, r in got.items():
        held = data[name]
        parts = [held[i : i + chunk] for i in range(0, len(held), chunk)] or [b""]
        tree = hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()
        assert (r.size, r.lines, r.chunks, r.sha256) == (len(held), len(held.splitlines()), len(parts), tree)


def test_measures_of_steps(spark, tmp_path):
    steps = profile.Measures()
    x = steps.at(spark.range(10), "read", n=F.count("*"), most=F.max("id"))
    x = steps.at(x.where("id > 6"), "kept", kept=F.count("*"))
    with pytest.raises(ValueError):
        steps.at(x, "kept")
    x.groupBy((F.col("id") % 2).alias("k")).count().write.parquet(str(tmp_path / "o"))
    assert steps.found() == {"n": 10, "most": 9, "kept": 3}
    none = profile.Measures()
    none.at(spark.createDataFrame([], "id long"), "read", n=F.count("*")).groupBy("id").count().write.parquet(str(tmp_path / "p"))
    assert none.found() in ({"n": None}, {"n": 0})

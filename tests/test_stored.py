import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from planarflow.operators import stored

SCHEMA = "k long, day string, at long, n long, high double"


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def batches():
    """Five batches with repeated keys inside and across them, nulls and ties."""
    out = []
    for b in range(5):
        out.append([((i * 7 + b) % 23, None if i % 11 == 0 else f"d{i % 3}", i, None if i % 5 == 0 else i + b, float(i % 4)) for i in range(40)])
    return out


def sql(statement, batches):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, day TEXT, at INTEGER, n INTEGER, high REAL)")
    for rows in batches:
        con.executemany(statement, sorted(rows, key=lambda r: (r[2], r[0])))
    return sorted(con.execute("SELECT * FROM t").fetchall(), key=str)


def rows(spark, path):
    return sorted((tuple(r) for r in stored.read(spark, path).select("k", "day", "at", "n", "high").collect()), key=str)


RULES = {"day": "last", "at": "min", "n": "sum", "high": "max"}
CONFLICT = "INSERT INTO t VALUES (?,?,?,?,?) ON CONFLICT(k) DO UPDATE SET day = excluded.day, at = min(at, excluded.at), n = CASE WHEN n IS NULL THEN excluded.n ELSE n + coalesce(excluded.n, 0) END, high = max(high, excluded.high)"


@pytest.mark.parametrize(("kind", "statement"), [("insert_new", "INSERT OR IGNORE INTO t VALUES (?,?,?,?,?)"), ("replace", "INSERT OR REPLACE INTO t VALUES (?,?,?,?,?)"), ("combine", CONFLICT)])
def test_batches_equal_a_database(spark, tmp_path, kind, statement):
    path = str(tmp_path / "t")
    for b, batch in enumerate(batches()):
        df = spark.createDataFrame(batch, SCHEMA).repartition(3)
        more = {"rules": RULES} if kind == "combine" else {}
        run = lambda: getattr(stored, kind)(df, path, ["k"], batch=b, order=["at", "k"], parts=4, **more)
        run()
        want = sql(statement, batches()[: b + 1])
        assert rows(spark, path) == want
        before = files(path)
        assert run() == [] and rows(spark, path) == want and files(path) == before  # a replayed batch changes nothing


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(i, f"d{i % 4}", i) for i in range(40)], "k long, day string, v long")
    stored.replace(first, path, ["day", "k"], 1, partition="day")
    before = files(path)
    assert stored.replace(spark.createDataFrame([(1, "d1", 99)], "k long, day string, v long"), path, ["day", "k"], 2, partition="day") == ["d1"]
    after = files(path)
    assert {p for p in before if "_part=d1" not in p} == {p for p in after if "_part=d1" not in p}
    assert all(before[p] == after[p] for p in before if "_part=d1" not in p)
    assert [tuple(r) for r in stored.changed_by(spark, path, 2).select("k", "v").collect()] == [(1, 99)]


def test_a_merge_that_was_stopped_is_finished(spark, tmp_path, monkeypatch):
    """The batch's rows lie beside the table, which has lost the partition that was being replaced."""
    path = str(tmp_path / "t")
    make = lambda n: spark.createDataFrame([(i, n) for i in range(20)], "k long, n long")
    stored.combine(make(1), path, ["k"], {"n": "sum"}, 1, parts=2)
    real = stored._replace

    def stopped(spark, p):
        if os.path.isdir(stored._staged(p)):
            import shutil

            shutil.rmtree(f"{path}/_part=1")
            raise RuntimeError("lost")
        return real(spark, p)

    monkeypatch.setattr(stored, "_replace", stopped)
    with pytest.raises(RuntimeError):
        stored.combine(make(10), path, ["k"], {"n": "sum"}, 2, parts=2)
    monkeypatch.setattr(stored, "_replace", real)
    stored.combine(make(10), path, ["k"], {"n": "sum"}, 2, parts=2)
    assert sorted(map(tuple, stored.read(spark, path).collect())) == [(i, 11) for i in range(20)]


def test_half_a_batch_is_not_taken_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, 1) for i in range(10)], "k long, n long")
    stored.combine(df.where("k < 5"), path, ["k"], {"n": "sum"}, 7)
    stored.combine(df, path, ["k"], {"n": "sum"}, 7)
    assert {r.n for r in stored.read(spark, path).collect()} == {1}


def test_update_delete_and_compact(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i if i else None, f"p{i % 3}", float(i) if i % 4 else None) for i in range(30)], "k long, p string, v double")
    stored.insert_new(df, path, ["p", "k"], 1, partition="p")
    assert sorted(stored.update(spark, path, F.col("v") > 25, {"v": F.lit(None).cast("double")}, 2)) == ["p0", "p2"]
    assert stored.update(spark, path, F.lit(False), {}, 3) == []
    assert stored.read(spark, path).where("v > 25").count() == 0 and stored.read(spark, path).count() == 30
    assert sorted(stored.delete(spark, path, (F.col("p") == "p0") | (F.col("v") == 1), 3)) == ["p0", "p1"]
    assert stored.delete(spark, path, (F.col("p") == "p0") | (F.col("v") == 1), 3) == []
    assert stored.read(spark, path).count() == 19
    stored.insert_new(df.where("k = 3"), path, ["p", "k"], 4, partition="p")
    assert stored.read(spark, path).where("k = 3").count() == 1
    stored.compact(spark, path)
    assert stored.read(spark, path).count() == 20 and stored._stored(spark, path).where(stored.GONE).where("_part = 'p1'").count() == 0


def test_no_rows_and_wrong_rules(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.createDataFrame([], "k long, n long")
    stored.insert_new(spark.createDataFrame([(1, 1)], "k long, n long"), path, ["k"], 1)
    assert stored.insert_new(empty, path, ["k"], 2) == []
    with pytest.raises(ValueError):
        stored.combine(empty, path, ["k"], {}, 3)


def test_merges_follow_a_stream(spark, tmp_path):
    """A stream's batches, the last of them run again from its checkpoint: sums are taken once."""
    source, path, marks = (str(tmp_path / n) for n in ("in", "t", "marks"))
    for i in range(3):
        spark.createDataFrame([(k, 1) for k in range(i, i + 4)], "k long, n long").write.mode("append").parquet(source)
    merge = lambda df, b: stored.combine(df, path, ["k"], {"n": "sum"}, b)

    def run():
        spark.readStream.schema("k long, n long").option("maxFilesPerTrigger", 2).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, stored.read(spark, path).collect()))

    want = [(0, 1), (1, 2), (2, 3), (3, 3), (4, 2), (5, 1)]
    assert run() == want
    last = max((f for f in os.listdir(f"{marks}/commits") if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        os.remove(f"{marks}/commits/{f}")
    assert run() == want

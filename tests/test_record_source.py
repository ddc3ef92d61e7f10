import gzip
import os

import pytest
from pyspark.sql import functions as F

from planarflow.sources import codec, files
from planarflow.sources.record_source import RecordSource, open_store


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(RecordSource)
    return spark


def rows(n=500):
    return [(bytearray(f"record {i}".encode() * (i % 40)), None if i % 50 == 0 else f"k/{i % 7}") for i in range(n)]


def written(spark, path, data=None, parts=3, mode="append", **options):
    df = spark.createDataFrame(data if data is not None else rows(), "record binary, bucket string").repartition(parts).sortWithinPartitions("bucket")
    df.write.format("records").options(key="bucket", **options).mode(mode).save(path)


def read(spark, path, **options):
    return spark.read.format("records").options(key="bucket", **options).load(path)


def pairs(df):
    return sorted(((bytes(r.record), r.bucket) for r in df.select("record", "bucket").collect()), key=str)


WANT = sorted(((bytes(r), k) for r, k in rows()), key=str)


def test_records_round_trip(source, tmp_path):
    path = str(tmp_path / "r")
    written(source, path)
    assert pairs(read(source, path)) == WANT
    assert sorted(os.listdir(path)) == ["_commits", "_temporary", "bucket=__HIVE_DEFAULT_PARTITION__", *(f"bucket=k%2F{i}" for i in range(7))]
    written(source, path)
    assert read(source, path).count() == 1000
    written(source, path, mode="overwrite")
    assert pairs(read(source, path)) == WANT


def test_files_end_at_a_limit_and_places_count_within_them(source, tmp_path):
    path = str(tmp_path / "r")
    written(source, path, parts=1, fileBytes=2000)
    by = read(source, path).groupBy("file").agg(F.sum(F.length("record")).alias("size"), F.max(F.length("record")).alias("most"), F.count("*").alias("n"), F.max("place").alias("last")).collect()
    assert len(by) > 20 and all(r.size - r.most < 2000 and r.last == r.n - 1 for r in by)


def test_the_format_is_that_of_record_files(source, tmp_path):
    path = str(tmp_path / "r")
    written(source, path)
    old = files.read_record_files(source, path)
    assert sorted(bytes(r.record) for r in old.collect()) == sorted(k for k, _ in WANT)
    codec.write_records(str(tmp_path / "one.gds.gz"), [b"a", b"", b"b" * 300])
    got = source.read.format("records").load(str(tmp_path / "one.gds.gz")).collect()
    assert [(bytes(r.record), r.place) for r in got] == [(b"a", 0), (b"", 1), (b"b" * 300, 2)]


def test_other_keys_leave_files_unopened(source, tmp_path):
    path = str(tmp_path / "r")
    written(source, path)
    for d in os.listdir(path):  # whoever opens another bucket's file fails
        if d.startswith("bucket=") and d != "bucket=k%2F3":
            for f in os.listdir(f"{path}/{d}"):
                with open(f"{path}/{d}/{f}", "wb") as out:
                    out.write(b"broken")
    assert pairs(read(source, path, keys='["k/3"]')) == [w for w in WANT if w[1] == "k/3"]
    assert read(source, path, keys='["none"]').count() == 0
    x = read(source, path, keys='["k/3", "none"]')
    assert x.where("bucket = 'none'").count() == 0 and x.count() == sum(w[1] == "k/3" for w in WANT)
    with pytest.raises(Exception):
        read(source, path).count()


def test_what_was_stopped_is_not_seen(source, tmp_path):
    path = str(tmp_path / "r")
    written(source, path)

    @F.udf("binary")
    def fails(record):
        if len(record) > 300:
            raise ValueError("lost")
        return bytes(record)

    bad = source.createDataFrame(rows(), "record binary, bucket string").repartition(4).withColumn("record", fails("record"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("records").option("key", "bucket").mode("append").save(path)
    assert pairs(read(source, path)) == WANT


def test_a_cut_off_file_raises(source, tmp_path):
    path = tmp_path / "x.gds.gz"
    path.write_bytes(gzip.compress(b"\x05abc"))
    with pytest.raises(Exception, match="cut off"):
        source.read.format("records").load(str(path)).collect()


def test_streams_read_and_write_commits(source, tmp_path):
    path, out, marks = (str(tmp_path / n) for n in ("r", "out", "marks"))

    def run():
        stream = source.readStream.format("records").option("key", "bucket").load(path).select(F.upper(F.col("record").cast("string")).cast("binary").alias("record"), "bucket")
        stream.writeStream.format("records").option("key", "bucket").option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        return pairs(read(source, out))

    upper = lambda held: sorted(((r.upper(), k) for r, k in held), key=str)
    written(source, path)
    assert run() == upper(WANT)
    assert run() == upper(WANT)  # nothing new
    more = [(bytearray(b"late"), "k/1")]
    written(source, path, more)
    want = upper([*WANT, (b"late", "k/1")])
    assert run() == want
    last = max((f for f in os.listdir(f"{marks}/commits") if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):  # the batch was written, but the stream did not learn it
        os.remove(f"{marks}/commits/{f}")
    assert run() == want


def test_empty_tables_nulls_and_paths(source, tmp_path):
    path = f"file:{tmp_path}/r"
    written(source, path, [])
    assert read(source, path).count() == 0
    written(source, path, [(None, None), (bytearray(b""), "")])
    assert pairs(read(source, path)) == [(b"", ""), (b"", None)]
    assert open_store("file:/a/b")[1] == open_store("file:///a/b")[1] == open_store("/a/b")[1] == "/a/b"
    with pytest.raises(Exception, match="path"):
        source.read.format("records").load().count()

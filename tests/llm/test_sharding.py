import random
import zlib

from pyspark.sql import functions as F

from planarflow.llm import sharding


def rows_of(df):
    out = df.collect()
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    return out


def held(rows, shards):
    sizes = [0] * shards
    for r in rows:
        sizes[r.shard] += r.size
    return sizes


def test_bytes_are_near_equal_and_equal_texts_together(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \né") for _ in range(rng.randrange(400))) for _ in range(3000)]
    texts += [t for t in texts[:300] for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = rows_of(sharding.shard_documents(docs, 7))
    sizes = held(got, 7)
    assert max(sizes) < 1.03 * min(sizes)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
    where = {}
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) == 0
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(docs.repartition(2), 7).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}


def test_a_hot_text_is_divided(spark):
    rows = [(i, "the same text again" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    sizes = held(rows_of(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 24)), 24)
    assert max(sizes) < 1.1 * min(sizes)


def test_own_dimensions(spark):
    rows = [(i, "x" * 50, float(i % 10)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality double")
    got = rows_of(sharding.shard_documents(docs, 2, {"quality": F.col("quality")}))
    low = {r.doc_id % 10 for r in got if r.shard == 0}
    assert len(low) == 5


def test_awkward_rows(docs, no_docs):
    got = rows_of(sharding.shard_documents(docs, 4))
    assert len(got) == docs.count()
    assert {r.size for r in got if r.doc_id == 2} == {8}
    assert sharding.shard_documents(no_docs).count() == 0


def by_hand(rows, first, last):
    """Shard of each row (k0, k1, k2, copy, size): cut at the weighted median of the axis whose keys spread widest."""
    if last - first <= 1:
        return {r: first for r in rows}
    axis = max(range(3), key=lambda a: (max(r[a] for r in rows) - min(r[a] for r in rows), -a))
    middle = (first + last) // 2
    goal = sum(r[4] for r in rows) * (middle - first) / (last - first)
    rows = sorted(rows, key=lambda r: (r[axis], r[3]))
    upto = k = 0
    while k < len(rows) and upto + rows[k][4] < goal:
        upto += rows[k][4]
        k += 1
    if k < len(rows) and goal - upto > upto + rows[k][4] - goal:
        k += 1
    return by_hand(rows[:k], first, middle) | by_hand(rows[k:], middle, last)


def test_cuts_equal_those_made_by_hand(spark):
    for seed, shards in ((1, 8), (2, 11)):
        rng = random.Random(seed)
        rows = [(*(rng.randrange(1 << 26) << 32 | rng.randrange(1 << 32) for _ in range(3)), rng.randrange(1 << 31), rng.randrange(80, 300)) for _ in range(200)]
        df = spark.createDataFrame(rows, "k0 long, k1 long, k2 long, copy long, size long").repartition(3)
        got = {(r.k0, r.k1, r.k2, r.copy, r.size): r.node for r in sharding.kd_tree(df, shards, 3).collect()}
        assert got == by_hand(rows, 0, shards)


def test_places_between_knots_keep_order(spark):
    x = [-5.0, 0.0, 0.1, 0.5, 1.0, 2.0, 3.0, 900.0, 1e9]
    got = [r.p for r in spark.createDataFrame([(v,) for v in x], "v double").select("v", sharding.between(F.col("v"), [0.0, 0.0, 1.0, 3.0, 1e6]).alias("p")).orderBy("v").collect()]
    assert got == sorted(got) and got[0] == got[1] == 0 and got[3] == 0.5 / 3 and got[-1] == 1


def test_an_outlier_does_not_choose_the_axis(spark):
    rows = [(i, "x", float(i % 40), 1e12 if i == 0 else float(i % 2)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a double, b double")
    got = rows_of(sharding.shard_documents(docs, 2, {"a": F.col("a"), "b": F.col("b")}))
    assert len({r.doc_id % 40 for r in got if r.shard == 0}) == 20


def test_a_document_larger_than_a_shard(spark):
    docs = spark.createDataFrame([(0, "y" * 500_000), *((i, "x" * (i % 90)) for i in range(1, 1000))], "doc_id long, text string")
    got = rows_of(sharding.shard_documents(docs, 4))
    assert len(got) == 1000 and sum(held(got, 4)) == sum(r.size for r in got)

import pytest
from pyspark.sql import functions as F

from planarflow.llm import mixing


def level(sizes, share=1.5):
    """Targets by raising a common level until all is shared."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        at = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= at * weight[s]}
        if not full:
            return out | {s: at * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def table(spark, sizes, docs=400):
    rows = [(i, " ".join("w" * 1 for _ in range(1 + i % (2 * n // docs))), s) for k, (s, n) in enumerate(sizes.items()) for i in range(k * docs, (k + 1) * docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_taken_words_come_near_targets(spark):
    docs = table(spark, {"a": 4000, "b": 8000, "c": 1600, None: 6000}).repartition(5)
    rows = mixing.mix(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.size == len(r.text.split()) and r.source_size
    want = level(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and taken[s] == pytest.approx(want[s], rel=0.02, abs=8)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(2)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_draws_are_disjoint_and_shards_even(spark):
    docs = table(spark, {"a": 4000, "b": 8000, "c": 1600})
    draws = mixing.mix(docs, shards=8).select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.pass", "d.shard")
    assert draws.groupBy("doc_id", "pass").count().where("count > 1").count() == 0
    sizes = [r["count"] for r in draws.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_splitting_keeps_quotas(spark):
    quotas = spark.createDataFrame([(0, 40), (1, 0), (2, 7), (3, 400)], "rank int, quota long")
    got = mixing.split_quotas(quotas, 6).collect()
    held, shard = {}, {}
    for r in got:
        held[r["rank"]] = held.get(r["rank"], 0) + r.quota
        shard[r.shard] = shard.get(r.shard, 0) + r.quota
        assert r.quota >= 0
    assert held == {0: 40, 1: 0, 2: 7, 3: 400} and max(shard.values()) - min(shard.values()) <= 2


def test_quantiles_of_the_hypergeometric(spark):
    from math import comb

    total, marked, drawn = 50, 20, 13
    rows = [(i / 40 + 0.0125,) for i in range(40)]
    u = spark.createDataFrame(rows, "u double")
    n = lambda x: F.lit(x).cast("long")
    got = [r.x for r in u.select("u", mixing._hypergeometric(n(total), n(marked), n(drawn), F.col("u")).alias("x")).orderBy("u").collect()]
    mass = [comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn) for k in range(drawn + 1)]
    for (q,), x in zip(rows, got):
        assert sum(mass[:x]) <= q + 1e-9 and sum(mass[: x + 1]) >= q - 1e-9


def test_awkward_rows(docs, no_docs):
    out = mixing.mix(docs.select("doc_id", "text", "lang", "source"))
    assert out.count() == docs.count()
    assert all(r.taken <= 2 * r.size for r in out.collect())
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() > 0
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0


def test_plan_has_no_python(docs):
    plan = mixing.mix(docs.select("doc_id", "text", "source"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("long", [20_000, 100_000])
def test_a_long_document_at_the_edge_does_not_end_the_filling(spark, long):
    """The long document's number is chosen so that the target lies in the middle of it."""
    sizes = [50 + 37 * i % 700 for i in range(500)]
    target = (sum(sizes) + long) * 0.5
    own = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    place = mixing._place(F.col("doc_id"), F.col("text")).alias("place")
    held = own.select(mixing.word_count(F.col("text")).alias("size"), place).collect()
    before = lambda r: sum(h.size for h in held if h.place < r.place)
    tries = spark.range(1000, 1200).select(F.col("id").alias("doc_id"), F.lit("w " * long).alias("text"), F.lit("a").alias("source"))
    one = min(tries.select("doc_id", place).collect(), key=lambda r: abs(before(r) + long / 2 - target))
    assert before(one) < target < before(one) + long
    docs = own.unionByName(tries.where(F.col("doc_id") == one.doc_id)).repartition(3)
    out = mixing.mix(docs, share=0.5).collect()
    left = [r.size for r in out if not r.taken]
    assert sum(r.taken for r in out) == pytest.approx(target, abs=min(left)) and all(r.taken in (0, r.size) for r in out)


@pytest.mark.parametrize(("long", "fill"), [(60_000, 500), (400, 60)])
def test_gaps_are_narrowed_by_prefixes(spark, monkeypatch, long, fill):
    """A document longer than the target, and a gap that takes several rules."""
    monkeypatch.setattr(mixing, "FILL", fill)
    sizes = [long] + [1 + 7 * i % 90 for i in range(1200)]
    docs = spark.createDataFrame([(i, "w " * n, "a" if i % 5 else None) for i, n in enumerate(sizes)], "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(docs, share=0.4).collect()
    for s in ("a", None):
        mine = [r for r in out if r.source == s]
        left = [r.size for r in mine if not r.taken]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=min(left))
    assert all(r.taken in (0, r.size) for r in out)
    again = mixing.mix(docs.repartition(5), share=0.4).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


def test_many_sources(spark):
    """More sources than one row may hold; targets and shards as with few."""
    n = 5_000
    docs = spark.range(3 * n).selectExpr("id AS doc_id", "repeat('w ', cast(1 + (id * 7) % 23 AS int)) AS text", f"concat('s', id % {n}) AS source")
    out = mixing.mix(docs).select("source", "size", "target", "taken", "draws").collect()
    sizes = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = level(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in out)
    assert sum(r.taken for r in out) == pytest.approx(sum(want.values()), rel=0.02)
    shards = [0] * mixing.SHARDS
    for r in out:
        for d in r.draws:
            shards[d.shard] += 1
    assert max(shards) - min(shards) <= 5 and max(shards) < 1.01 * min(shards)


def test_groups_of_sources_keep_quotas(spark):
    quotas = spark.createDataFrame([(i, i * i % 50) for i in range(37)], "rank int, quota long")
    held, shard = {}, {}
    for r in mixing.split_quotas(quotas, 6, 4).collect():
        held[r["rank"]] = held.get(r["rank"], 0) + r.quota
        shard[r.shard] = shard.get(r.shard, 0) + r.quota
        assert r.quota >= 0
    assert held == {i: i * i % 50 for i in range(37)} and max(shard.values()) - min(shard.values()) <= 3


@pytest.mark.parametrize(("copies", "size", "share", "want"), [(300, 10, 2500 / 3000, 2500), (300, 10, 2504 / 3000, 2500), (300, 10, 1.5, 4500), (300, 10, 0.5 / 3000, 0), (50, 700, 0.5, 17500)])
@pytest.mark.parametrize("fill", [1 << 14, 100])
def test_copies_of_one_row_are_counted(spark, monkeypatch, copies, size, share, want, fill):
    """Rows equal in doc_id and text: as many as fit are taken, whatever other columns say."""
    monkeypatch.setattr(mixing, "FILL", fill)
    rows = spark.range(copies).selectExpr("7L AS doc_id", f"repeat('w ', {size}) AS text", "'a' AS source", "id AS lang").repartition(4)
    out = mixing.mix(rows, share=share).collect()
    assert len(out) == copies and sum(r.taken for r in out) == want and all(r.taken <= 2 * r.size for r in out)
    assert len({r.lang for r in out}) == copies
    assert mixing.mixed_rows(rows, share=share).count() == want // size


def plain_mix(rows, target, blocks=mixing.BLOCKS, fill=mixing.FILL):
    """taken by place of one source's rows (place, size), target by target, without rules."""
    held = {}
    for place, size in rows:
        held.setdefault((place, size), []).append(size)
    total = sum(size for _, size in rows)
    whole = int(target // total)
    rest, order = target - whole * total, sorted(held)
    block = lambda place: int(place[:8], 16) * blocks >> 32
    until = max(rest - min(max(s for _, s in rows), fill), 0.0)
    at, took, left = 0, dict.fromkeys(order, 0), rest
    while at < len(order) and rest - left + sum(held[order[at]]) <= until:
        took[order[at]] = len(held[order[at]])
        left -= sum(held[order[at]])
        at += 1
    after, gap, near, upto = [k for k in order[at:] if k[1]], left, [], {}
    for k in after:
        if k[1] <= gap and upto.get(k[1].bit_length(), 0) < gap:
            near.append(k)
            upto[k[1].bit_length()] = upto.get(k[1].bit_length(), 0) + sum(held[k])

    def fitted(docs):
        room, out = gap, {}
        for k in docs:
            out[k] = min(len(held[k]), int(room // k[1]))
            room -= out[k] * k[1]
        return room, out

    left, more = fitted(near)
    other = fitted(sorted(near, key=lambda k: (-k[1], k[0])))
    if left > mixing.CLOSE * target and other[0] < left:
        left, more = other
    took.update(more)
    last = [(abs(k[1] - left), *k) for k in after if abs(k[1] - left) < left and took[k] < len(held[k])]
    if last:
        took[min(last)[1:]] += 1
    assert all(block(a) <= block(b) for (a, _), (b, _) in zip(order, order[1:]))
    return {k: sorted((1 + whole if i < took[k] else whole) * k[1] for i in range(len(held[k]))) for k in order}


@pytest.mark.parametrize("share", [0.3, 0.77, 1.5])
def test_taken_equals_a_plain_mix_row_by_row(spark, share):
    """Sources with long documents, copies and empty texts against the same order in plain Python."""
    sizes = [1 + 37 * i % 300 for i in range(900)] + [5000, 9000, 0, 0]
    rows = [(i, "w " * n, "abc"[i % 3]) for i, n in enumerate(sizes)] + [(5000 + i % 2, "v " * (40 + 31 * (i % 2)), "ab"[i % 2]) for i in range(500)]
    rows += [(6000, "u " * 90, "d")] * 200 + [(None, "x " * 17, None)] * 90 + [(i, "y " * (i % 50), None) for i in range(7000, 7400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(docs, share=share).select("source", "size", "target", "taken", "place").collect()
    assert len(out) == len(rows)
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        want = plain_mix([(r.place, r.size) for r in mine], mine[0].target)
        got = {}
        for r in mine:
            got.setdefault((r.place, r.size), []).append(r.taken)
        assert {k: sorted(v) for k, v in got.items()} == want

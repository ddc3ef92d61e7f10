import random
import zlib

import numpy as np
import pytest

from planarflow.llm import toxicity as t

BAD = ["vileword", "scumlike", "idiotic"]


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["w%d" % rng.randrange(3000) for _ in range(rng.randrange(10, 80))]
        bad = rng.random() < 0.15
        for _ in range(rng.randrange(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in t.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    for i, text in rows:
        assert got[i].predicted == any(b in text for b in BAD)


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = corpus(600)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (t.fit_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (a.buckets == b.buckets).all() and (a.weights == b.weights).all() and a.bias == b.bias


def test_the_unlabelled_part_does_not_turn_negative():
    """A plain fit with all unlabelled ones as negatives would call hidden positives clean."""
    pos = [np.array([1, 2])] * 50
    unl = [np.array([1, 2])] * 40 + [np.array([9, i + 20]) for i in range(160)]
    model = t.fit_nnpu(pos, unl, 0.2)
    score = lambda ids: model.bias + sum(dict(zip(model.buckets, model.weights)).get(i, 0) for i in ids)
    assert score([1, 2]) > 1.5 > -1 > score([9])


def test_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = t.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert t.toxicity_scores(no_docs, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 6) for r in t.toxicity_scores(docs, none).collect()} == {t.DEFAULT_PRIOR}
    scored = t.with_score(docs.withColumnRenamed("score", "other"), t.fit_toxicity(docs, none))
    assert "lang" in scored.columns


@pytest.mark.parametrize("text", ["", "  ", "Wort-mit. ZEICHEN"])
def test_features_see_words_and_beginnings(text):
    doc, bucket = t.word_features([text.lower().encode()])
    assert len(bucket) == {0: 0, 3: 4}.get(len(text.replace("-", " ").split()), 0) or len(bucket) >= 3


def test_repeated_ids_and_rows_bound_the_sample(spark):
    rows, labels = corpus(400)
    toxic = next(i for i, y in labels if y and zlib.crc32(str(i).encode()) % 3 != 1)
    many = spark.range(200_000).selectExpr(f"{toxic}L AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same text' ELSE concat('vileword w', id) END AS text")
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(many)
    seen = []

    def kept(got, buckets):
        seen.append(got.groupBy("positive").count().collect())
        return real(got, buckets)

    real, t._kept = t._kept, kept
    try:
        model = t.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), positives=300, unlabelled=500)
    finally:
        t._kept = real
    assert {r["positive"]: r["count"] <= (300 if r["positive"] else 500) for r in seen[0]} == {True: True, False: True}
    assert len(model.buckets)


def test_fit_equals_one_in_memory(spark):
    rows, labels = corpus(800, 5)
    model = t.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int"))
    known = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    share = sum(known.values()) / len(known)
    features = {i: np.unique(t.word_features([x.lower().encode()])[1]) for i, x in rows}
    unl = [f for i, f in features.items() if zlib.crc32(str(i).encode()) % 3 != 1]
    plain = t.fit_nnpu([features[i] for i, y in known.items() if y], unl, share + (share * (1 - share) / len(known)) ** 0.5)
    assert sorted(plain.buckets) == sorted(model.buckets) and abs(plain.bias - model.bias) < 1e-6
    both = [dict(zip(m.buckets.tolist(), m.weights.tolist())) for m in (plain, model)]
    assert all(abs(both[0][b] - both[1][b]) < 1e-6 for b in both[0])


def test_long_texts_are_read_in_windows(monkeypatch):
    import planarflow.llm.common as c

    text = ("Some words, here and THERE. Σίσυφος " * 90_000 + "x" * 3_000_000).encode()
    (_, _, _, long), = t.sliced_features([text])
    assert long.tolist() == t.word_features([text.decode().lower().encode()])[1].tolist()
    assert len(list(c.windows(text))) > 2

import random

import numpy as np
import pytest

from planarflow.llm import jaccard
from planarflow.llm.common import shingle_hashes, word_hashes


def shingles(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    group = {}
    for i in range(len(rows)):
        group.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in group.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=str)


def found(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in jaccard.similar_documents(df).collect()), key=str)


def corpus(seed, n=160):
    """Copies and near copies of a few texts, many at the threshold, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(2000)
    base = [[word() for _ in range(rng.randrange(20, 90))] for _ in range(8)]
    common = [word() for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.3:
            t = [word() for _ in range(40)] + common
        if rng.random() < 0.2:
            t = t[: rng.randrange(len(t) + 1)]
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize(("seed", "sample"), [(0, 10_000), (1, 40), (2, 1)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, sample):
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    monkeypatch.setattr(jaccard, "SHARE", 1.0)
    rows = corpus(seed)
    assert found(spark, rows) == classes(rows)


@pytest.mark.parametrize("flat", [0, 2])
def test_fragments_dealt_in_two_steps(spark, monkeypatch, flat):
    monkeypatch.setattr(jaccard, "SAMPLE", 5)
    monkeypatch.setattr(jaccard, "SHARE", 1.0)
    rows = corpus(5, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.similar_documents(df, flat=flat, fragment=1 << 10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == classes(rows)


@pytest.mark.parametrize("sample", [10_000, 30])
def test_pairs_equal_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    monkeypatch.setattr(jaccard, "SHARE", 1.0)
    rows = corpus(7, 120)
    pairs, members = jaccard.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    under = {}
    for r in members.collect():
        under.setdefault(r.rep, set()).add(r.doc_id)
    got = {frozenset((x, y)) for r in pairs.collect() for x in under[r.a] for y in under[r.b]}
    got |= {frozenset((x, y)) for ids in under.values() for x in ids for y in ids if x < y}
    sets = {i: shingles(t) for i, t in rows}
    assert got == {frozenset((x, y)) for x in sets for y in sets if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])}


@pytest.mark.parametrize("text", [b"one two", b"one two three", b"x " * 3_000_000 + b"y" * 5_000_000 + b" z" * 9])
def test_short_and_long_texts_alone(text):
    words = text.split()
    want = len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) or 1
    doc, tokens = shingle_hashes([text])
    again = shingle_hashes([text.replace(b" ", b"  ").replace(b"y", b"Y"), b"a b c d e f"])
    assert len(tokens) == want and sorted(tokens) == sorted(again[1][again[0] == 0])


def test_awkward_rows(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in jaccard.similar_documents(docs).collect()), key=str) == classes(rows)
    assert jaccard.similar_documents(no_docs).count() == 0


def test_shingles_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", 7)
    rows = corpus(9, 120)
    assert found(spark, rows) == classes(rows)


def test_hashes_follow_words_alone():
    a, b = "One\ttwo  THREE four\nfive six", "one two three four five six"
    _, x = shingle_hashes([a.encode()])
    _, y = shingle_hashes([b.encode(), b"padding before", b""])
    assert len(x) == 2 and set(x) <= set(y)
    assert not len(word_hashes([b"", b" \n"])[0])
    doc, _ = shingle_hashes([b"", b"few words", b"a b c d e f", b"a b c d e a b c d e"])
    assert np.bincount(doc, minlength=4).tolist() == [0, 1, 2, 5]

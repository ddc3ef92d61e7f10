import hashlib
import re

import pytest

from planarflow.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for bare, held in groups.items():
        best = min(held)
        for _, _, _, i in held:
            out.append((rows[i][0], rows[best[3]][0], len(held), i == best[3], hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_awkward_rows(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(exact_dedup.copies(docs)) == brute(rows)


@pytest.mark.parametrize("support", [0.5, 0.05, 0.001])
def test_frequent_and_rare_groups_equal_brute_force(spark, support):
    """A third of all rows are copies of one text in different spacing; ties, repeats, null doc_ids and null texts."""
    rows = [(i, " a\tb " + " " * (i % 7)) for i in range(200)] + [(i % 50, f"t{i % 90} é ") for i in range(300)] + [(None, "a b"), (None, None), (3, "\x0b\x0c"), (2, ""), (2, "")]
    rows += [(1000 + i, f"alone {i}" + "x" * 500 * (i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(exact_dedup.copies(df, support=support)) == brute(rows)


def test_frequent_digests_are_broadcast_and_leave_before_the_shuffle(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)]
    seen = {}
    real = exact_dedup.cut

    def cut(df, label):
        out = real(df, label)
        seen[label] = [r.asDict() for r in out.collect()]
        return out

    monkeypatch.setattr(exact_dedup, "cut", cut)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(exact_dedup.copies(df, support=0.1)) == brute(rows)
    hot = hashlib.sha256(b"hot").hexdigest()
    assert hot in {r["text_sha256"] for r in seen["frequent"]} and len(seen["frequent"]) <= 10
    assert hot not in {r["text_sha256"] for r in seen["repeated"]}


def test_whole_rows_that_stay(spark, docs):
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    want = sorted(((r[0]) for r in brute([tuple(r) for r in docs.select("doc_id", "text").collect()]) if r[3]), key=str)
    assert sorted((r[0] for r in kept.select("doc_id").collect()), key=str) == want


def test_empty_table(spark, no_docs):
    assert exact_dedup.copies(no_docs).count() == 0
    assert exact_dedup.without_copies(no_docs).count() == 0


def test_no_python_workers(spark, docs):
    plan = exact_dedup.copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest

from planarflow.llm import token_files, word_bpe
from planarflow.llm.common import shared_dir, tokenizer_path

pytest.importorskip("tokenizers")
PATH = tokenizer_path("word_bpe_49k.json")


def test_ids_are_those_of_the_library():
    rng = random.Random(3)
    parts = ["a", "the", "É", "ß", "ñ", " ", "\n", "'s", "'", "1", "<|endoftext|>", "...", "!", "×", "œ", "İ", "ing", "ABC", "\t", "_", "x" * 30, "Ÿ", "Ã", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(10))) for _ in range(4000)] + ["", None]
    t = word_bpe.tokenizer(PATH)
    for text, ids in zip(texts, t.encode(pa.array(texts))):
        assert ids.tolist() == t.lib.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1, 2, 3, 300, 5000])
def test_codes_are_prefix_free_and_short(size):
    rng = np.random.default_rng(size)
    counts = np.zeros(size + 5, np.int64)
    counts[rng.permutation(size + 5)[:size]] = (rng.pareto(0.3, size) * 10).astype(np.int64) % 10**9 + 1
    lengths = token_files.code_lengths(counts)
    assert lengths.max() <= token_files.MAX_BITS and ((lengths > 0) == (counts > 0)).all()
    assert (2.0 ** -lengths[lengths > 0]).sum() <= 1
    ids = rng.choice(np.flatnonzero(counts), 3000)
    words, marks = token_files.pack(ids, token_files.canonical_codes(lengths), lengths)
    (back,) = token_files.unpack([(words, marks, len(ids))], token_files.decode_table(lengths))
    assert (back == ids).all()


def test_limited_lengths_are_optimal():
    counts = np.array([1, 1, 2, 4, 8, 16, 32])
    lengths = token_files.code_lengths(counts, 4)
    best = min(
        sum(c * n for c, n in zip(counts, choice))
        for choice in __import__("itertools").product(range(1, 5), repeat=7)
        if sum(2.0**-n for n in choice) <= 1
    )
    assert (counts * lengths).sum() == best


def test_files_hold_all_documents_in_order(spark, docs):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, partitions=3)
    got = token_files.read_ids(spark, path).orderBy("start").collect()
    t = word_bpe.tokenizer(PATH)
    want = sorted(((r.doc_id, [*t.lib.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(r.doc_id, r.ids) for r in got] == want
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens


def test_empty_table(no_docs):
    assert token_files.token_file_digests(no_docs).count() == 0


def test_a_doc_id_of_many_rows_is_divided(spark):
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "CASE WHEN id % 2 = 0 THEN 'the same' ELSE concat('text ', id) END AS text")
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    token_files.write_token_files(rows, path, partitions=6)
    parts = spark.read.parquet(f"{path}/blocks").selectExpr("part", "size(doc_ids) AS n").groupBy("part").sum("n").collect()
    assert len(parts) == 6 and max(r[1] for r in parts) < 1500
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got) and len(got) == 6000
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_long_texts_in_windows(spark, monkeypatch):
    monkeypatch.setattr(token_files, "WINDOW", 1024)
    monkeypatch.setattr(token_files, "STEP_BYTES", 3000)
    texts = ["Some words,\tand\nmore of THEM é! " * 900, "x", "the end " * 200, None]
    t = word_bpe.tokenizer(PATH)
    ids = [np.array([*t.lib.encode(x or "", add_special_tokens=False).ids, 2]) for x in texts]
    all_ = np.concatenate(ids)
    lengths = token_files.code_lengths(np.bincount(all_))
    words, marks = token_files.pack(all_, token_files.canonical_codes(lengths), lengths)
    assert len(marks) == -(-len(all_) // token_files.STRIDE)
    back = list(token_files.windows_of(words, marks, len(all_), token_files.decode_table(lengths)))
    assert len(back) > 5 and (np.concatenate(back) == all_).all()
    from planarflow.llm.common import windows

    cuts = list(windows(texts[0].encode(), 3000, token_files._CUTS))
    assert len(cuts) > 5 and [i for w in cuts for i in t.encode(pa.array([w.decode()]))[0]] == ids[0][:-1].tolist()


def test_a_very_long_text_through_the_files(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").unionByName(spark.range(1).selectExpr("3L AS doc_id", "concat(repeat('many words here ', 900000), 'end') AS text"))
    got = {r.doc_id: r for r in token_files.token_file_digests(docs).collect()}
    t = word_bpe.tokenizer(PATH)
    one = t.lib.encode("many words here many words here end", add_special_tokens=False).ids
    ids = np.array([*one[:3] * 900_000, *one[6:], 2], "<u4")
    assert (got[3].n_tokens, got[3].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert [got[k].start for k in (1, 2, 3)] == [0, 3, 4]
